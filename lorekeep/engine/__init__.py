"""Session helpers, shared-folder tables and the facade."""
