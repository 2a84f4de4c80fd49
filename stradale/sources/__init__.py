"""Sources and sinks: registries of named builders, way tables, chips, frozen records, artifacts."""
