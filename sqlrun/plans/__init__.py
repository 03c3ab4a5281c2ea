"""Run planning: isolated session, dataset registration, view chain, query; plan inspection."""
