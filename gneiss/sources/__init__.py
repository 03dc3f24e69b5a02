"""Sources: source trees, node-link graphs and git histories."""
