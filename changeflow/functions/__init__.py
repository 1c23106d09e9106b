"""Column functions: masking, diffing, wire format, log positions and routing."""
