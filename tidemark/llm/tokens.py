"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words seen."""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
MEMORY = 700_000                     # words an encoder remembers, about 150 MB
SLICE = 1 << 20
PART = 5000                          # words encoded in one go, parted by a control character of their own
MARK = b"\x01"
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
# pieces that the normaliser only lower-cases and the splitter parts into punctuation, letters and punctuation:
# Latin letters that are composed already and whose small letter is one letter, no apostrophe, no part of a special token
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
SIMPLE = re.compile(rf'([("\[]*)([{LETTERS}]+)([.,;:!?)"\]]*)').fullmatch


def file_of(name: str) -> str:
    """A tokenizer file's place: an absolute path, or a name of the installed public files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _lowers_and_splits(tokenizer) -> bool:
    """Whether a tokenizer composes, lower-cases, parts letters from all else and then works on bytes, as ``SIMPLE`` needs."""
    import json
    made = json.loads(tokenizer.to_str())
    normal = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if made["model"]["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"]:
        return False
    parts = set(split[0]["pattern"].get("Regex", "").split("|"))
    return ({r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= parts and all(p[0] == "'" or p[0] == "[" for p in parts) and split[0]["invert"]
            and not split[1]["add_prefix_space"] and not split[1]["use_regex"])


def _byte_letters() -> dict[int, str]:
    """What stands for each Latin letter and mark in a byte-level vocabulary."""
    from tokenizers.pre_tokenizers import ByteLevel
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x180)}


class Encoder:
    """Ids of texts as the tokenizers library gives them without special tokens.

    For tokenizers that drop white space, a text's ids are those of its space-separated pieces, one after the other;
    pieces are encoded by the library once and remembered. ``whole=True`` hands each text to the library in one go.
    """

    def __init__(self, name: str, whole: bool = False, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file_of(name))
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.whole, self.memory, self.known = whole, memory, {}
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.runs: dict[str, bytes] = {}
        self.model, self.letters = (self.tokenizer.model, _byte_letters()) if _lowers_and_splits(self.tokenizer) else (None, {})

    def _run(self, run: str) -> bytes:
        """Ids of a run of small letters or of punctuation, by the model itself."""
        raw = self.runs.get(run)
        if raw is None:
            if len(self.runs) > self.memory:
                self.runs.clear()
            size = self.kind.itemsize
            raw = self.runs[run] = b"".join([t.id.to_bytes(size, "little") for t in self.model.tokenize(run.translate(self.letters))])
        return raw

    def _learn_simple(self, words: list[bytes]) -> list[bytes]:
        """Learn the words that fall into runs without the library's normaliser and splitter; the others are returned."""
        rest, run = [], self._run
        for w in words:
            m = SIMPLE(w.decode())
            if m is None:
                rest.append(w)
                continue
            before, letters, after = m.groups()
            raw = run(letters.lower())
            if before:
                raw = run(before) + raw
            self.known[w] = raw + run(after) if after else raw
        return rest

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        new = [w for w in words if w not in known]  # a set difference would walk all that is known
        if len(self.known) + len(new) > self.memory:  # words learned early are the common ones: these stay, with those in use
            early = dict(itertools.islice(self.known.items(), self.memory // 2))
            self.known = early | {w: self.known[w] for w in words & self.known.keys()}
        if self.model is not None:
            new = self._learn_simple(new)
        plain = [w for w in new if MARK not in w and b"<|" not in w]
        for i in range(0, len(plain), PART):
            part = plain[i:i + PART]
            text = (b" " + MARK + b" ").join(part).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:
                raise ValueError("the tokenizer does not keep the mark apart; use whole=True")
            raw, size = ids.tobytes(), self.kind.itemsize
            ends = [*(marks * size).tolist(), len(raw)]
            starts = [0, *((marks + 1) * size).tolist()]
            self.known.update(zip(part, [raw[x:y] for x, y in zip(starts, ends)]))
        if len(plain) < len(new):
            odd = [w for w in new if w not in self.known]
            for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, self.kind).tobytes()

    def _slices(self, raw: bytes):
        start = 0
        while len(raw) - start > SLICE:
            cut = SPACE.search(raw, start + SLICE)
            if cut is None:
                break
            yield raw[start:cut.start()]
            start = cut.start()
        yield raw[start:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One id array per text; None counts as empty."""
        if self.whole:
            return [np.array(e.ids, self.kind)
                    for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out: list = [None] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if t and len(t) > SLICE:
                out[i] = np.concatenate([self._join([s.split()])[0] for s in self._slices(t.encode())])
            else:
                short.append(i)
        for i, ids in zip(short, self._join([texts[i].encode().split() if texts[i] else [] for i in short])):
            out[i] = ids
        return out

    def _join(self, pieces: list[list[bytes]]) -> list[np.ndarray]:
        self._learn(set().union(*pieces))
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, p)), self.kind) for p in pieces]


@functools.lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY, whole: bool = False) -> Encoder:
    """The encoder of this Python worker; what it remembers serves all tasks the worker runs."""
    return Encoder(name, whole)
