"""Errors of the library; each names what it is about."""


class EngineError(Exception):
    """Base of all."""


class ConfigError(EngineError):
    """A configuration value is malformed or unknown."""


class ProfileError(EngineError):
    """A profile is malformed or not to be found."""


class RegistrationError(EngineError):
    """A source or dataset lacks a key that later stages need."""

    def __init__(self, message: str, field: str | None = None):
        super().__init__(message)
        self.field = field


class MissingFieldError(EngineError):
    """A required field is missing or blank."""

    def __init__(self, table: str, field: str, rows: list[str] = ()):
        super().__init__(f"{table}: required field {field!r} is missing" + (f" in {', '.join(rows)}" if rows else ""))
        self.table, self.field, self.rows = table, field, list(rows)


class LeakageError(EngineError):
    """Train and test share a key."""

    def __init__(self, key: str, shared: list[str]):
        super().__init__(f"{key}: in both parts: {', '.join(shared)}")
        self.key, self.shared = key, list(shared)


class LayoutError(RegistrationError):
    """A path template is not usable."""


class UndeclaredFeatureError(EngineError):
    """A value has a name the feature set does not declare."""


class UnimplementedFeatureError(EngineError):
    """A feature is declared available and nothing computes it."""


class ViewMismatchError(EngineError):
    """A source's or feature's view is not the skeleton's, or not declared."""


class IsolationError(EngineError):
    """The output folder would be kept under version control."""
