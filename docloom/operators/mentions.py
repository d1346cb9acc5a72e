"""Which entities of a dictionary a text names, as whole folded words.

The dictionary becomes a trie of words.  It is broadcast, in parts of checked size where it is large, and each text is
walked once for each part: at every word the longest path of the trie that the text follows is gone along.  Names have
any number of words.  Time is linear in the text for names of bounded length; nothing but the result is shuffled.

Defined results: a name without letters or digits names nothing; a null text names nothing; the same name may stand
for several entities and each is counted; names inside longer names count too; rows that share an id are summed.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A part of the dictionary that is sent to all tasks has so many bytes of names and entities at most, on average.
MOST_BYTES = 16 << 20
#: What a word of a name costs beside its bytes.
WORD_BYTES = 100

_tries: dict[str, dict] = {}


def trie(names: Iterable[tuple[str, object]]) -> dict:
    """Nested dictionaries by word; the key '' holds the entities of the name that ends there."""
    root: dict = {}
    for gram, entity in names:
        node = root
        for word in gram.split(" "):
            node = node.setdefault(word, {})
        node.setdefault("", []).append(entity)
    return root


def walk(words: list[str], root: dict, first: dict | None = None) -> Counter:
    """How often each entity's name stands in a text's words; ``first`` gets the word's number where it does first."""
    found: Counter = Counter()
    for i, word in enumerate(words):
        node, j = root.get(word), i
        while node is not None:
            if "" in node:
                found.update(node[""])
                if first is not None:
                    for entity in node[""]:
                        first.setdefault(entity, i + 1)
            j += 1
            node = node.get(words[j]) if j < len(words) else None
    return found


def _find(names: Broadcast, token: str, id_type: pa.DataType, entity_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _tries:  # once for each worker; earlier parts make room
            _tries.clear()
            _tries[token] = trie(names.value)
        root = _tries[token]
        for batch in batches:
            ids, entities, counts, firsts = [], [], [], []
            for key, line in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                first: dict = {}
                found = walk(line.split(" "), root, first)
                ids += [key] * len(found)
                entities += found
                counts += found.values()
                firsts += [first[e] for e in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(entities, entity_type), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], names=["id", "entity", "n", "first"])

    return run


def mention_join(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES, places: bool = False) -> DataFrame:
    """``id_col, entity, n``: how often each entity's name (``names``: ``entity, name``) stands in each text.

    ``places`` adds ``first``, the number of the word with which its first name begins.

    A dictionary of more than ``most_bytes`` is dealt by hash to parts; the texts are then walked once for each part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    words = T.tokens(F.col("name"))
    dictionary = names.select("entity", F.array_join(words, " ").alias("gram")).filter("gram != '' and entity is not null").distinct()
    cost = F.octet_length("gram") + F.octet_length(F.col("entity").cast("string")) + F.size(F.split("gram", " ")) * WORD_BYTES
    size = dictionary.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    # The words are joined into one line here, so that no later step cuts a text again for each of its words.
    lines = docs.select(F.col(id_col).alias("id"), F.array_join(T.tokens(F.col(text_col)), " ").alias("line"))
    types = lines.schema["id"].dataType, dictionary.schema["entity"].dataType
    schema = f"id {types[0].simpleString()}, entity {types[1].simpleString()}, n long, first long"
    found = []
    for i in range(parts):
        part = dictionary.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i)
        sent = spark.sparkContext.broadcast([(r["gram"], r["entity"]) for r in part.toLocalIterator()])
        found.append(lines.mapInArrow(_find(sent, uuid.uuid4().hex, *map(to_arrow_type, types)), schema))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.groupBy(F.col("id").alias(id_col), "entity").agg(F.sum("n").alias("n"), *[F.min("first").alias("first")] * places)


def in_order(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, people``: each text's entities by their first place, then by themselves; ``found`` has places.

    An entity comes once, so a list is no longer than the dictionary.
    """
    listed = F.array_sort(F.collect_list(F.struct("first", "entity")))
    return found.groupBy(id_col).agg(F.transform(listed, lambda x: x["entity"]).alias("people"))
