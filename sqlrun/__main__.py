"""``python -m sqlrun SPEC [RUN_ID] [--query SQL] [--preview N]``."""

from .plans.runner import main

raise SystemExit(main())
