"""The run ledger: append-only tables of runs, stages, gates and events, and reports over them."""
