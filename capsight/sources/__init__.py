"""Sources and sinks: capture files, event logs, published runs, knowledge files."""
