"""Error classes raised while a plan is built."""


class ConfigurationError(ValueError):
    """A parameter or an option is out of its range."""


class DataError(ValueError):
    """The input tables cannot carry the computation."""
