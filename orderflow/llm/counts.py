"""Token counts by dynamic programming over a trie of distinct words.

Words (runs without white space, with the vocabulary's word mark in front) reach each bucket once (see ``words``). Their sorted list is
walked as a trie: the forward scores of a prefix, that is the best total log-probability of a segmentation up to each of its
characters and the number of its tokens, are computed once and shared by all words below; at a word's end its count is stored.
A document's count is the sum over its words.

The unigram model is a public piece vocabulary. The file has an order of pieces but no probabilities, so a piece has Zipf's: minus the
logarithm of its place. A character in no piece costs its bytes, each less likely than any piece. Of equally likely segmentations the
one with fewest tokens counts.

Defined cases: null, empty and blank texts have no words and 0 tokens; a word of any length is segmented whole; repeated rows
and ids give a row each; an empty table gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

import math
import re
from os.path import commonprefix

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import WORD
from orderflow.llm.words import answered, reassembled, split_blocks

MARK = "▁"


def read_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a vocabulary, by their place."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return {piece: -math.log(place + 2) for place, piece in enumerate(plain)}


def trie_counts(words: list[str], pieces: dict[str, float]) -> list[int]:
    """Tokens of the best segmentation of each word. Words are visited in order, so the forward scores of the prefix that a
    word shares with the one before are there already."""
    longest = max(map(len, pieces), default=1)
    byte = -math.log(len(pieces) + 2) - 1.0
    out = [0] * len(words)
    path, score, tokens = "", [0.0], [0]
    for at in sorted(range(len(words)), key=words.__getitem__):
        word = words[at]
        shared = len(commonprefix((path, word)))
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode())
            best, least = score[end - 1] + n * byte, tokens[end - 1] + n
            for begin in range(max(0, end - longest), end):
                own = pieces.get(word[begin:end])
                if own is not None:
                    total, count = score[begin] + own, tokens[begin] + 1
                    if total > best or total == best and count < least:
                        best, least = total, count
            score.append(best)
            tokens.append(least)
        path = word
        out[at] = tokens[len(word)]
    return out


def token_counts(docs: DataFrame, pieces: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_tokens`` of each text."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary file: fixed size

    def splitter():
        return lambda value: [MARK + w for w in re.findall(WORD, value)]

    def answerer():
        return lambda words: [[n] for n in trie_counts(words, held.value)]

    blocks = split_blocks(docs, key, text, splitter)
    found = reassembled(blocks, answered(blocks, answerer), docs.schema[key].dataType)
    total = F.aggregate("values", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return found.select(F.col("key").alias(key), "n_words", total.alias("n_tokens"))
