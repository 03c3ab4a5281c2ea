"""SQL-side helpers: parameter templating and typed arguments."""
