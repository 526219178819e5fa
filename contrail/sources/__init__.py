"""Sources and sinks: fixture views, file formats, resumable keyed jobs."""
