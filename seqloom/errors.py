"""Errors of the engine; each carries a short message for the user."""


class SeqloomError(Exception):
    """Base of all errors raised on purpose."""


class InvalidInput(SeqloomError):
    """A parameter or a combination of inputs that makes no sense."""


class MalformedInput(SeqloomError):
    """A file or table whose contents break its format."""


class ConfigError(SeqloomError):
    """A configuration that can't be read or is incomplete."""


class RenderError(SeqloomError):
    """An image that can't be laid out or written."""


class MethylationError(SeqloomError):
    """A methylation track that contradicts itself or its sequence; ``kind`` names the check."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind
