"""Errors of a library run.  `kind` is what outcome columns hold."""


class CadenzaError(Exception):
    kind = "io"
    recoverable = False


class FileMissing(CadenzaError):
    kind, recoverable = "file_not_found", True


class UnsupportedFormat(CadenzaError):
    kind, recoverable = "unsupported_format", True


class DecodeError(CadenzaError):
    kind, recoverable = "decode", True


class AnalysisError(CadenzaError):
    kind, recoverable = "analysis", True


class StemUnavailable(CadenzaError):
    kind = "stem_unavailable"


class InferenceError(CadenzaError):
    kind = "inference"


class OutputError(CadenzaError):
    kind = "output"


class ConfigError(CadenzaError):
    kind = "config"


STEM_KINDS = (StemUnavailable.kind, InferenceError.kind)
