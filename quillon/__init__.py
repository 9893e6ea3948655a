"""A PySpark analytics engine for multi-tenant telemetry."""
