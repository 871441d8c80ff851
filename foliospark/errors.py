"""Errors as data: every failure has a code, and travels as a column wherever a job must go on."""

from __future__ import annotations

#: The codes that inputs, images, renderers, recognisers and the command line report.
CODES = frozenset(
    """CLI_MISSING_VALUE CLI_INVALID_SPLIT_RATIO CLI_INVALID_WATERMARK_MODE CLI_INVALID_PAGE_LAYOUT CLI_UNKNOWN_OPTION CLI_TOO_MANY_INPUTS CLI_INCOMPATIBLE_OPTIONS
    BATCH_PARTIAL_FAILURE UNEXPECTED_ERROR
    INPUT_READ_FAILED INPUT_UNSUPPORTED_TYPE INPUT_NO_IMAGES INPUT_INVALID_DOCX INPUT_IMAGE_MISSING INPUT_UNSAFE_RELATIONSHIP INPUT_INVALID_ZIP INPUT_UNSAFE_ZIP_PATH
    INPUT_UNSUPPORTED_ZIP64 INPUT_ZIP_ENTRY_MISSING INPUT_ENCRYPTED_ZIP INPUT_UNSUPPORTED_ZIP_METHOD
    IMAGE_INVALID_DIMENSIONS IMAGE_INVALID_BUFFER IMAGE_INVALID_CROP IMAGE_INVALID_SCALE IMAGE_INVALID_SPLIT_RATIO IMAGE_NOT_LANDSCAPE IMAGE_UNSAFE_SPLIT
    IMAGE_INVALID_WATERMARK_MODE IMAGE_CODEC_UNAVAILABLE IMAGE_UNSUPPORTED_CHANNELS IMAGE_DECODE_FAILED IMAGE_ENCODE_FAILED
    PDF_RENDERER_UNAVAILABLE PDF_RENDERER_NOT_FOUND PDF_RENDERER_START_FAILED PDF_RENDER_TIMEOUT PDF_RENDER_FAILED PDF_NO_PAGES
    OCR_INVALID_BLOCK OCR_UNSAFE_ASSET_PATH OCR_ASSET_MISSING OCR_MARKDOWN_NOT_FOUND OCR_ENGINE_NOT_FOUND OCR_ENGINE_START_FAILED OCR_ENGINE_FAILED OCR_ENGINE_TIMEOUT""".split()
)


class FolioError(Exception):
    """A failure with a code of :data:`CODES`."""

    def __init__(self, code: str, message: str = "", **details: object) -> None:
        super().__init__(message or code)
        self.code, self.details = code, details


def as_folio_error(error: BaseException, code: str, message: str = "") -> FolioError:
    """Errors that already have a code pass through."""
    if isinstance(error, FolioError):
        return error
    wrapped = FolioError(code, message)
    wrapped.__cause__ = error
    return wrapped


def summary(error: BaseException) -> dict[str, str]:
    """(code, message) of any error, as written to results."""
    return {"code": error.code if isinstance(error, FolioError) else "UNEXPECTED_ERROR", "message": str(error)}


def diagnostic_tail(error: BaseException, limit: int = 4000) -> str:
    """The end of what a failed process wrote to stderr."""
    text = error.details.get("stderr") if isinstance(error, FolioError) else None
    return text.strip()[-limit:] if isinstance(text, str) else ""
