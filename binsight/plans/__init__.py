"""The reports (R01-R55), grouped by subject, and the registry of the
queries run by the driver (``catalog``)."""
