"""Functions of the engine, built on the DataFrame API."""
