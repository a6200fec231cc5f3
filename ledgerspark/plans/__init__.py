"""Jobs that combine operators: store, import, registered queries."""
