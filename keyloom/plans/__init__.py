"""Strategy choice, plan inspection and batch packing."""
