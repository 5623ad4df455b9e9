"""Exceptions raised eagerly, before any Spark job runs."""


class FusionError(Exception):
    """Base of all errors of this library."""


class LogicError(FusionError):
    pass


class ImageTypeError(FusionError):
    pass


class FileFormatError(FusionError):
    pass


class NotImplementedFeature(FusionError):
    pass


class SizeError(FusionError):
    pass


class NotFound(FusionError):
    pass


class InvalidArgument(FusionError):
    pass
