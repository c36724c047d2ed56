"""leadloom: Spark jobs that turn listing and web-page snapshots into clean business leads."""
