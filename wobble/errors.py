"""The library's errors."""


class WobbleError(Exception):
    """A computation can't go on."""


class ConfigError(WobbleError):
    """Inputs or settings are wrong."""
