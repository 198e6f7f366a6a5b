"""Packing documents into fixed-length token sequences: first-fit decreasing on a tournament tree (operator 4).

Documents are dealt to randomised groups by the hash of their id, their text and, for repeated rows, their number in the
task that tokenises them, so null and repeated ids spread like others; about ``group_docs`` each; every group packs alone. Whole
lengths of ``width`` are cut off first, the rests are placed by first-fit decreasing: a tournament tree over the rooms of
the bins finds the first bin that still takes a rest. Then the emptiest bins are cut up to fill the gaps of the fuller ones,
and the last bin's rest is cut at powers of two, which need no padding.

Null and empty texts are one end token. Equal lengths are ordered by doc_id, then by their tokens. Repeated rows are
documents of their own. An empty table gives no rows. A text of any length is tokenised and cut whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import ship_package, table, text_class, words_of
from quayside.llm.registry import register

CACHE_WORDS = 250_000
#: Rows that a task encodes at once.
ROWS = 1_000
#: Letters whose lower case and normal form are one letter each, then ASCII signs that take part in no contraction.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of words as little-endian 32-bit numbers, each distinct word encoded once per task, whose worker keeps nothing of it.

    White space ends every token of this kind of tokenizer, so the ids of a text are those of its words in order. A plain word
    is further a run of letters and a run of signs, which the tokenizer also splits; many words share them. Full tables are
    emptied, so memory stays bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def encode_parts(self, parts: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(parts):
            raw, start = ids.tobytes(), 0
            for part, end in zip(parts, (4 * ends).tolist()):
                self.parts[part] = raw[start:end]
                start = end
        else:
            for part, code in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
                self.parts[part] = np.array(code.ids, "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts = {"": b""}
        words, letters, signs, other, other_texts = [], [], [], [], []
        for word in new:
            text = word.decode("utf-8", "replace")
            match = PLAIN.fullmatch(text)
            if match:
                words.append(word)
                letters.append(match[1].lower())
                signs.append(match[2])
            else:
                other.append(word)
                other_texts.append(text)
        missing = [p for p in dict.fromkeys(letters + signs) if p not in self.parts]
        for k in range(0, len(missing), 5_000):
            self.encode_parts(missing[k : k + 5_000])
        for word, a, b in zip(words, letters, signs):
            self.words[word] = self.parts[a] + self.parts[b]
        for word, code in zip(other, self.tokenizer.encode_batch_fast(other_texts, add_special_tokens=False)):
            self.words[word] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """Every word is looked up once; words that are not known yet are learnt for 256 texts together and filled in."""
        out = []
        for first in range(0, len(texts), 256):
            open_texts, new = [], {}
            for text in texts[first : first + 256]:
                words = words_of(text)
                codes = list(map(self.words.get, words))
                gaps = [i for i, code in enumerate(codes) if code is None]
                if gaps:
                    missing = [words[i] for i in gaps]
                    new.update(dict.fromkeys(missing))
                    open_texts.append((len(out), codes, gaps, missing))
                    out.append(b"")
                else:
                    out.append(b"".join(codes))
            if new:
                self.learn(list(new))  # which may empty the table first, and then holds all of these
            for at, codes, gaps, missing in open_texts:
                for i, word in zip(gaps, missing):
                    codes[i] = self.words[word]
                out[at] = b"".join(codes)
        return out


class Tournament:
    """The largest room below every inner node; finds the first bin with room enough in logarithmic time."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        room, node, size = self.room, 1, self.size
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        return node - size

    def take(self, bin_: int, amount: int) -> None:
        room, node = self.room, bin_ + self.size
        room[node] -= amount
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2


def pack(lengths: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); ``lengths`` in decreasing order of what is to be placed first."""
    full, rests = [], []
    for doc, n in enumerate(lengths):
        full += [[(doc, start, width)] for start in range(0, n - width + 1, width)]
        if n % width:
            rests.append((n % width, doc, n - n % width))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, bins = Tournament(max(1, len(rests)), width), []
    for n, doc, start in rests:
        at = tree.first(n)
        if at == len(bins):
            bins.append([])
        tree.take(at, n)
        bins[at].append((doc, start, n))

    def used(pieces):
        return sum(p[2] for p in pieces)

    bins.sort(key=used, reverse=True)
    rooms = [width - used(b) for b in bins]
    low, high = 0, len(bins) - 1
    while low < high:
        if not rooms[low]:
            low += 1
        elif not bins[high]:
            high -= 1
        else:
            doc, start, n = bins[high].pop()
            part = min(n, rooms[low])
            bins[low].append((doc, start, part))
            rooms[low] -= part
            rooms[high] += part
            if part < n:
                bins[high].append((doc, start + part, n - part))
    bins = [b for b in bins if b]  # emptied ones first, or the one that is half full would not be the last
    last = bins.pop() if bins and used(bins[-1]) < width else []
    while last:
        need, piece_list = 1 << (used(last).bit_length() - 1), []
        while need:
            doc, start, n = last.pop()
            part = min(n, need)
            piece_list.append((doc, start, part))
            need -= part
            if part < n:
                last.append((doc, start + part, n - part))
        bins.append(piece_list)
    return full + bins


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, the ids of every text with the end token, as bytes, d (text class) and nth (of the task's rows of that id and text)."""
    ship_package(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        encoder = WordEncoder(path)
        for batch in (whole.iloc[first : first + ROWS] for whole in batches for first in range(0, len(whole), ROWS)):
            nth = []
            for key in zip(batch["doc_id"].astype("Int64").fillna(-1), batch["d"]):
                nth.append(seen[hash(key)])
                seen[hash(key)] += 1
            narrow = [np.frombuffer(x + tail, "<u4") for x in encoder.encode(list(batch["text"]))]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in narrow], "wide": [bool(x.max() >= 1 << 16) for x in narrow], "d": batch["d"], "nth": nth})

    return docs.select(F.col("doc_id").cast("long"), "text", text_class().alias("d")).mapInPandas(run, "doc_id long, ids binary, wide boolean, d long, nth long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, width: int = 4096, group_docs: int = 2_000, group_bytes: int = 16 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    There are as many groups as keep the average below ``group_docs`` documents and ``group_bytes`` bytes of text.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-size // group_bytes))
    dealt = tokenised(docs, tokenizer, end).withColumn("part", F.pmod(F.xxhash64("doc_id", "d", "nth"), F.lit(groups))).drop("d", "nth")

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4") for x, wide in zip(group["ids"], group["wide"])]
        doc_ids = [None if pd.isna(d) else int(d) for d in group["doc_id"]]
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc_ids[i] is None, doc_ids[i] or 0, group["ids"].iat[i]))
        rows, first = [], int(group["part"].iat[0]) << 32
        for k, pieces in enumerate(pack([len(ids[i]) for i in order], width)):
            offset = 0
            for place, start, n in pieces:
                i = order[place]
                rows.append((doc_ids[i], start, n, ids[i][start : start + n].tobytes(), len(ids[i]), first + k, offset))
                offset += n
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    return dealt.groupBy("part").applyInPandas(pack_group, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op4_pack_sequences")
def op4_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
