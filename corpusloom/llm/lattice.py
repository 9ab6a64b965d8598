"""The unigram lattice of pre-tokens over a SentencePiece vocabulary; the path of its file is a parameter.

A text is cut into pre-tokens: one blank or none with the characters up to the next blank or line end; a
single blank; a line end. A piece of the vocabulary never crosses a pre-token. Its blank sign stands for the blank, and a
character that no piece holds falls back to the ids of its UTF-8 bytes, so every text can be written
and read back exactly. The file ranks its pieces and has no probabilities, so a piece of rank r
gets the Zipf weight -log(r + ZIPF).
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

#: Added to a rank before the logarithm; the log weight of a byte id.
ZIPF, BYTE = 10.0, -14.0
PRE_TOKEN = re.compile(r" ?[^ \n]+| |\n")
BLANK = "▁"


class Vocabulary:
    """Pieces in a trie of reversed strings, so one walk finds all pieces that end at a place."""

    def __init__(self, pieces: dict[str, tuple[float, int]], byte_ids: list[int], raw: list[bytes]):
        self.byte_ids, self.raw = byte_ids, raw
        self.root: dict = {}
        for piece, entry in pieces.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = (entry[0], (entry[1],))

    def ending(self, w: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, log weight, ids) of each piece of ``w`` that ends before place ``end``; never empty."""
        out, node, at = [], self.root, end
        while at:
            at -= 1
            node = node.get(w[at])
            if node is None:
                break
            hit = node.get("")
            if hit:
                out.append((at, *hit))
        if not out or out[0][0] != end - 1:
            raw = w[end - 1].encode("utf-8", "replace")
            out.append((end - 1, BYTE * len(raw), tuple(self.byte_ids[x] for x in raw)))
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, raw, rank = {}, [0] * 256, [b""] * sp.get_piece_size(), 0
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text = sp.id_to_piece(i).replace(BLANK, " ")
            raw[i] = text.encode()
            if len(PRE_TOKEN.findall(text)) == 1:  # others would cross a pre-token
                pieces[text] = (-log(rank + ZIPF), i)
            rank += 1
    return Vocabulary(pieces, byte_ids, raw)


def shared_prefixes(words: list[str]):
    """The trie of ``words`` in depth-first order: (word, length of the prefix it shares with the one before)."""
    before = ""
    for w in sorted(words):
        same, most = 0, min(len(w), len(before))
        while same < most and w[same] == before[same]:
            same += 1
        yield w, same
        before = w
