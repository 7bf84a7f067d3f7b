"""tallyhouse: marketplace-event metrics as Spark batch and streaming jobs."""
