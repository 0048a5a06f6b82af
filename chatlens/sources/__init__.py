"""Sources and sinks: Parquet parts, CSV samples, keyed layouts, fixture adapters."""
