"""Discovery, the slow-log data source, file states and the snapshot store."""
