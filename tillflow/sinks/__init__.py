"""Writers.  Batch writers are idempotent: repeating a batch changes nothing."""
