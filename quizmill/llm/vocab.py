"""Files of public tokenizers, and where their encodings may be cut.

`public_tokenizers.path(name)` gives a file's place on every machine; models are loaded once in each Python worker. Nothing is trained."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cache

import numpy as np

#: White space as the tokenizers' patterns mean it (Unicode's White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
AFTER_BLANK, NO_BLANKS = r"[ \t-\r]", r"[^ \t-\r]+"
_LOADED: dict[str, object] = {}


def load(name: str):
    """The library's object for a file: tokenizers for .json, tiktoken for .tiktoken, sentencepiece for .model."""
    if name not in _LOADED:
        import public_tokenizers as public

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        path = public.path(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            _LOADED[name] = Tokenizer.from_file(path)
        elif name.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _LOADED[name] = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            import sentencepiece

            _LOADED[name] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[name]


@cache  # the whole vocabulary is read for it
def stable_boundary(name: str) -> re.Pattern:
    """Matches end where any encoding of a text may be cut, whatever stands further left or right.

    * Splitters that drop white space (word vocabularies): behind an ASCII blank. No unit of the pattern, no special token and no normalisation reaches over a blank.
    * Byte-level splitters and sentencepiece: before a space that follows something else than white space. Units of the pattern hold white space only at their begin, and no piece of the vocabulary has a space behind another character (checked here)."""
    before_space = re.compile(f"[^{WHITE}](?= )")
    if name.endswith(".json"):
        spec = json.loads(load(name).to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{name}: a special token reaches over blanks")
        if any(s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"] and re.search(r"\[\^\\s", s["pattern"]["Regex"]) for s in steps):
            return re.compile(AFTER_BLANK)
        if not spec["normalizer"] and steps[-1].get("type") == "ByteLevel" and steps[-1]["use_regex"]:
            return before_space
        raise ValueError(f"{name}: no boundary is proven for this splitter")
    if name.endswith(".model"):
        model = load(name)
        pieces = (model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()))
        if any(re.search("[^ ] ", piece) for piece in pieces):
            raise ValueError(f"{name}: pieces reach over spaces")
    return before_space


def token_ends(name: str, texts: list[str]) -> list[list[int]]:
    """For each text the places (code points) where its tokens end, in order; several tokens may end inside one character, at the same place."""
    model = load(name)
    if name.endswith(".json"):
        model.encode_special_tokens = False  # the default; op11 sets it on the same object
        return [[end for _, end in e.offsets] for e in model.encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".tiktoken"):
        out = []
        for text in texts:
            ids = model.encode_ordinary(text)
            starts = [*model.decode_with_offsets(ids)[1], len(text)] if ids else []
            out.append(starts[1:])
        return out
    out = []
    for text in texts:
        begins = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # of characters, in bytes, as sentencepiece counts
        out.append(np.searchsorted(begins, [p.end for p in model.encode(text, return_type="proto").pieces]).tolist())
    return out


def count_tokens(name: str, texts: list[str]) -> list[int]:
    """Tokens of each whole text."""
    model = load(name)
    if name.endswith(".json"):
        model.encode_special_tokens = False
        return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    if name.endswith(".tiktoken"):
        return [len(model.encode_ordinary(t)) for t in texts]
    return [len(x) for x in model.encode(texts, num_threads=1)]


def token_bytes(name: str) -> list[bytes]:
    """What each id stands for: byte-level entries decoded; sentencepiece's pieces in UTF-8 with U+2581 as a space, byte pieces as their byte."""
    model = load(name)
    if name.endswith(".model"):
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(i) for i in range(model.get_piece_size()))]
    if name.endswith(".tiktoken"):
        return [model.decode_single_token_bytes(i) for i in range(model.n_vocab)]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(of[c] for c in token) if all(c in of for c in token) else token.encode() for token in (model.id_to_token(i) for i in range(model.get_vocab_size()))]
