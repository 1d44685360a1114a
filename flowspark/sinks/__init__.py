"""Writers: topics, routed alerts, document tables, model tables."""
