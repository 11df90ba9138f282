"""Sources and sinks: graph archives, the artifact store, score shards."""
