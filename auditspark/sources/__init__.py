"""Sources and sinks: source trees, tool outputs, manifests, artifacts; index tables and exports."""
