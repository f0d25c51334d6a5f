"""The registered queries: each operator run over whole tables, with its SQL check."""
