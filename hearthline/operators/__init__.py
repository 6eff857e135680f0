"""``DataFrame -> DataFrame`` steps, to be chained with ``DataFrame.transform``."""
