"""The kinds of errors, each with its prefix. All are ValueErrors, so callers may catch that."""

from __future__ import annotations


class Error(ValueError):
    """prefix: what a message of this kind begins with."""

    prefix = "Error"

    def __init__(self, what: str):
        super().__init__(f"{self.prefix}: {what}")


def _kind(name: str, prefix: str, doc: str) -> type[Error]:
    return type(name, (Error,), {"prefix": prefix, "__doc__": doc, "__module__": __name__})


PlaceholderError = _kind("PlaceholderError", "Placeholder Error", "Stands for an error without a kind of its own.")
CodecError = _kind("CodecError", "Codec Error", "An input that can't be encoded or decoded.")
ProtocolError = _kind("ProtocolError", "Protocol Error", "A message that the transport can't carry.")
CompressionError = _kind("CompressionError", "Compression Error", "Data that can't be compressed or decompressed.")
EncryptionError = _kind("EncryptionError", "Encryption Error", "Data or keys that can't be sealed or opened.")
SchemaError = _kind("SchemaError", "Schema Error", "A schema that can't be read, or a value that doesn't fit it.")
PredicateError = _kind("PredicateError", "Predicate Error", "A condition that can't be evaluated.")
IndexError_ = _kind("IndexError_", "Index Error", "An index that can't be built or read.")
WasmError = _kind("WasmError", "Wasm Error", "A module that can't be run.")
InternalError = _kind("InternalError", "Internal Error", "A fault of the library itself.")

KINDS: dict[str, type[Error]] = {
    "placeholder": PlaceholderError, "codec": CodecError, "protocol": ProtocolError, "compression": CompressionError, "encryption": EncryptionError,
    "schema": SchemaError, "predicate": PredicateError, "index": IndexError_, "wasm": WasmError, "internal": InternalError,
}


def of_io(error: OSError) -> CodecError:
    """An error of reading or writing, as the codec's."""
    return CodecError(f"IO Error during codec operation: {error}")


def kind_of(message: str) -> str | None:
    """The kind that a message's prefix tells; None for other messages."""
    return next((name for name, kind in KINDS.items() if message.startswith(f"{kind.prefix}: ")), None)
