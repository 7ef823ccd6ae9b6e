"""Sources and sinks: catalogue, file scans, dataset builders, writers."""
