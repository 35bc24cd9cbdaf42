"""Exact tokenization with memoised words.

Both public tokenizers used here work word by word, so a text's tokens are
the concatenation of its words' tokens.  The memo is per Python worker and
bounded; when it is full it starts anew.
"""

from __future__ import annotations

import os
import re

import numpy as np

MEMO_ENTRIES = 600_000
#: White space of the tokenizer's \s that str.split() also splits on; the
#: four separators U+001C to U+001F are split by str.split() alone.
_SPLIT_DIFFERS = re.compile("[\x1c-\x1f]")
_CORE_AND_TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-;=?-@\[-`{}~]*)")
_encoders: dict = {}


class WordEncoder:
    """Ids of a `tokenizers` file whose pre-tokenizer drops white space.

    ids_bytes(text) gives the ids as little-endian unsigned 32-bit bytes,
    equal to Tokenizer.encode(text, add_special_tokens=False).ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _alphabetic(self, words: list[str], out: dict[str, bytes]) -> None:
        """Words of letters only give one pre-token each, whose last id is an end."""
        for at in range(0, len(words), 2000):
            part = [words[i : i + 50] for i in range(at, min(at + 2000, len(words)), 50)]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(group):
                    raw, start = ids.tobytes(), 0
                    for word, stop in zip(group, stops.tolist()):
                        out[word] = raw[4 * start : 4 * stop]
                        start = stop
                else:
                    for word in group:
                        out[word] = self.whole(word)

    def learn(self, texts: list[list[str]]) -> None:
        unseen = set()
        memo = self.memo
        for words in texts:
            unseen.update(words)
        unseen = [w for w in unseen if w not in memo]
        if len(memo) + len(unseen) > MEMO_ENTRIES:
            memo.clear()
            unseen = list({w for words in texts for w in words})
        plain, parts, rest = set(), [], []
        for w in unseen:
            m = _CORE_AND_TAIL.fullmatch(w)
            if m and m[1].isalpha():
                plain.add(m[1])
                if m[2]:
                    parts.append((w, m[1], m[2]))
            else:
                rest.append(w)
        self._alphabetic([w for w in plain if w not in memo], memo)
        for tail in {p[2] for p in parts}:
            if tail not in memo:
                memo[tail] = self.whole(tail)
        for w, core, tail in parts:
            memo[w] = memo[core] + memo[tail]
        for at in range(0, len(rest), 5000):
            chunk = rest[at : at + 5000]
            for w, e in zip(chunk, self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False)):
                memo[w] = np.array(e.ids, "<u4").tobytes()

    def ids_bytes(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        later = []
        get = self.memo.__getitem__
        for i, t in enumerate(texts):
            if _SPLIT_DIFFERS.search(t):
                out[i] = self.whole(t)
                continue
            words = t.split()
            try:
                out[i] = b"".join(map(get, words))
            except KeyError:
                later.append((i, words))
        self.learn([words for _, words in later])
        for i, words in later:
            out[i] = b"".join(map(get, words))
        return out


class PieceEncoder:
    """Tokens of a `sentencepiece` model with the places where they end.

    The vocabulary is scanned once for the pairs of characters that stand side
    by side in any piece.  The model merges neighbouring characters into pieces
    and neither rewrites nor trims text, so no merge can cross a pair that no
    piece holds: every such place is a token boundary, whatever stands around
    it.  That is the proof `stable` rests on.  It covers the space after a word
    (if no piece holds one there), most pairs of ideographs and many of
    unspaced codes.
    """

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        self.word_local = (
            not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces
            and not trainer.treat_whitespace_as_suffix
            and trainer.model_type == trainer.BPE
            and all(self.SPACE not in p.piece.lstrip(self.SPACE) for p in proto.pieces)
            and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        )
        #: Without byte pieces, neighbouring unknown characters become one token.
        self.paired = {p.piece[i : i + 2].replace(self.SPACE, " ") for p in proto.pieces for i in range(len(p.piece) - 1)} if self.word_local and trainer.byte_fallback else None
        self.prefix = spec.add_dummy_prefix
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def stable(self, text: str, at: int) -> bool:
        """Whether a token surely ends before text[at], inside the text."""
        return self.paired is not None and 0 < at < len(text) and text[at - 1 : at + 1].replace(self.SPACE, " ") not in self.paired

    def last_stable(self, text: str, low: int, high: int) -> int:
        """The last stable place after low and before high, or -1."""
        if self.paired is None:
            return -1
        paired, part = self.paired, text[max(0, low) : high].replace(self.SPACE, " ")
        for k in range(len(part) - 1, 0, -1):
            if part[k - 1 : k + 1] not in paired:
                return max(0, low) + k
        return -1

    def _word_counts(self, texts: list[list[str]]) -> None:
        memo = self.memo
        unseen = {w for words in texts for w in words if w not in memo}
        if len(memo) + len(unseen) > MEMO_ENTRIES:
            memo.clear()
            unseen = {w for words in texts for w in words}
        unseen = list(unseen)
        for at in range(0, len(unseen), 10_000):
            part = unseen[at : at + 10_000]
            memo.update(zip(part, map(len, self.model.encode(part, num_threads=1))))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts of single spaces only go word by word."""
        out: list = [None] * len(texts)
        later = []
        get = self.memo.__getitem__
        for i, t in enumerate(texts):
            if not (self.word_local and self.prefix and t and t[0] != " " and t[-1] != " " and "  " not in t and self.SPACE not in t):
                out[i] = self.count(t)
                continue
            words = t.split(" ")
            try:
                out[i] = sum(map(get, words))
            except KeyError:
                later.append((i, words))
        self._word_counts([words for _, words in later])
        for i, words in later:
            out[i] = sum(map(get, words))
        return out

    def boundaries(self, text: str) -> np.ndarray:
        """Character offsets where tokens end, in order.

        The library gives UTF-8 offsets; the parts of a character that is
        spelt in bytes may all end where it begins, which no stable boundary
        separates.
        """
        ends = np.array([p.end for p in self.model.encode(text, return_type="proto", num_threads=1).pieces], np.int64)
        if text.isascii():
            return ends
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return np.searchsorted(np.concatenate([[0], np.cumsum(size)]), ends)


def word_encoder(path: str) -> WordEncoder:
    if ("w", path) not in _encoders:
        _encoders["w", path] = WordEncoder(path)
    return _encoders["w", path]


def piece_encoder(path: str) -> PieceEncoder:
    if ("p", path) not in _encoders:
        _encoders["p", path] = PieceEncoder(path)
    return _encoders["p", path]
