"""Reports, the read-only SQL surface and the driver's queries."""
