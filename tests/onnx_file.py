"""Small ONNX files, written field by field, with a tokenizer of whole words beside them."""

import numpy as np


def _varint(n):
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _message(*fields):
    return b"".join(_field(n, v) for n, v in fields)


def _value(name, kind, dims):
    shape = _message(*[(1, _message((2, d) if isinstance(d, str) else (1, d))) for d in dims])
    return _message((1, name), (2, _message((1, _message((1, kind), (2, shape))))))


def write_model(folder, table: np.ndarray, words: list[str], summed: bool = False):
    """A model that looks up a row of the table for each token; `summed`: and adds them up for each text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tensor = _message((1, table.shape[0]), (1, table.shape[1]), (2, 1), (8, "table"), (9, table.astype("<f4").tobytes()))
    nodes = [_message((1, "table"), (1, "input_ids"), (2, "rows"), (4, "Gather"))]
    out, dims = "rows", ["batch", "length", table.shape[1]]
    if summed:
        nodes.append(_message((1, "rows"), (2, "sums"), (4, "ReduceSum"), (5, _message((1, "axes"), (8, 1), (20, 7))), (5, _message((1, "keepdims"), (3, 0), (20, 2)))))
        out, dims = "sums", ["batch", table.shape[1]]
    graph = _message(*[(1, n) for n in nodes], (2, "g"), (5, tensor), (11, _value("input_ids", 7, ["batch", "length"])), (12, _value(out, 1, dims)))
    (folder / "model.onnx").write_bytes(_message((1, 6), (8, _message((1, ""), (2, 11))), (7, graph)))
    known = Tokenizer(models.WordLevel({"[PAD]": 0, "[UNK]": 1} | {w: i + 2 for i, w in enumerate(words)}, unk_token="[UNK]"))
    known.pre_tokenizer = pre_tokenizers.Whitespace()
    known.save(str(folder / "tokenizer.json"))
