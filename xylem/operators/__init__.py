"""Relations derived from XML text: events, trees, attributes, namespaces, records."""
