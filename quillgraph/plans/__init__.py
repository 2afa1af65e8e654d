"""Named queries composed from operators, each with its SQL counterpart."""
