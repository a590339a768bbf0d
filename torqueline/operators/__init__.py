"""operators of the engine; see the modules."""
