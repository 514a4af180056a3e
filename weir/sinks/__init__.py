"""Where records go: JSONL files, topics, a spool, publishers."""
