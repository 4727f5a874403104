"""Tokenizers from vocabulary files, with a bounded memo of pieces between which no token can reach."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Entries of a worker's memo; it is emptied when full, which costs time but changes no result.
MEMO = 1_000_000
_RUN = re.compile(r"\s\s")
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
#: The family's pattern, and the same without look-ahead, which only runs of white space need.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_NO_RUNS = PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s")


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_core(path: str, probes: tuple[str, ...] = ("Hello, wörld!  two\n\n three's 12345 ", " \t x é漢字 -- ||")):
    """tiktoken's faster core over the same vocabulary, for any text and for texts without runs of white space; or None.

    Only for a plain byte-level BPE whose ids are in merge order, which makes both libraries' merges the same; the
    file's own tokenizer must agree on the probes.
    """
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = _byte_alphabet()
    try:
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    except KeyError:
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    import tiktoken

    runs, fast = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, PATTERN_NO_RUNS))
    own = _load(path)
    if any(runs.encode_ordinary(p) != own.encode(p, add_special_tokens=False).ids for p in probes):
        return None
    return runs, fast


class ByteIds:
    """Ids of whole texts under a byte-level tokenizer file, as the tokenizers library gives them without added tokens.

    Texts that hold one of the file's special strings go to the library itself.
    """

    def __init__(self, path: str):
        self.tok = _load(path)
        self.core = byte_level_core(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"

    def ids(self, text: str) -> array:
        if self.core is None or any(s in text for s in self.special):
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids)
        return array(self.code, self.core[1 if _RUN.search(text) is None else 0].encode_ordinary(text))


class Counter:
    """Token counts of texts under a tokenizer file.

    For word-end vocabularies that drop white space, a text's count is the sum over its words, so words are remembered;
    with any other file each text is encoded whole.
    """

    def __init__(self, path: str):
        self.tok = _load(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.by_word = bool(spec["model"].get("end_of_word_suffix")) and all(not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        self.by_word = self.by_word and self.tok.encode("a b\t\nc", add_special_tokens=False).ids == [i for w in "abc" for i in self.tok.encode(w, add_special_tokens=False).ids]
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        memo, out, later = self.memo, [], {}
        if len(memo) > MEMO:
            memo.clear()
        # str.split() also parts at separators that are no white space to the tokenizer.
        split = [t.split() if t.isascii() and not _SEPARATOR.search(t) else _BLANKS.split(t) for t in texts]
        split = [[w for w in ws if w] for ws in split]
        get = memo.get
        for words in split:
            got = list(map(get, words))
            if None in got:
                later.update((w, None) for w, n in zip(words, got) if n is None)
        if later:
            self._learn(list(later))
        for words in split:
            out.append(sum(map(memo.__getitem__, words)))
        return out

    def _learn(self, words: list[str], block: int = 20_000) -> None:
        """Encode unseen words joined by spaces and hand each token back to the word that its offset lies in."""
        for at in range(0, len(words), block):
            part = words[at : at + block]
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            offsets = self.tok.encode(" ".join(part), add_special_tokens=False).offsets
            at_char = np.fromiter((o[0] for o in offsets), dtype=np.int64, count=len(offsets))
            n = np.bincount(np.searchsorted(starts, at_char, side="right") - 1, minlength=len(part)) if len(offsets) else np.zeros(len(part), int)
            self.memo.update(zip(part, n.tolist()))
