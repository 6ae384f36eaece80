"""N-grams counted by Arrow, some documents at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17  # words counted at a time, and the rest of a document


def gram_counts(keys: list[str], lo: int = 1, hi: int = 2, size: int = SLICE):
    """A task for ``mapInArrow``: ``(*keys, _term, _tf, _texts)`` to ``(*keys, term, tf)``.

    A row with a term is counted already and passes. Any other is a document;
    ``_texts`` holds the word lists of its texts, and no n-gram reaches from one
    into the next. Words are numbered within a slice of whole documents, so
    that grouping and counting see numbers only.
    """
    places = [f"w{i}" for i in range(hi)]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [pa.field(k, batch.schema.field(k).type) for k in keys]
            schema = pa.schema([*heads, ("term", pa.string()), ("tf", pa.int64())])
            done = batch.filter(pc.is_valid(batch["_term"])).select([*keys, "_term", "_tf"])
            yield pa.RecordBatch.from_arrays(done.columns, schema=schema)
            batch = batch.filter(pc.is_null(batch["_term"]))
            lists = pc.list_flatten(batch["_texts"])
            words = pc.list_flatten(lists)
            text = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            doc = pc.list_parent_indices(batch["_texts"]).to_numpy(zero_copy_only=False)[text]
            borders = np.flatnonzero(np.diff(doc)) + 1
            cuts = borders[np.diff(borders // size, prepend=0) > 0]
            bounds = [0, *cuts.tolist(), len(doc)]
            for first, last in zip(bounds, bounds[1:]):
                coded = words.slice(first, last - first).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                grams = []
                for n in range(lo, hi + 1):
                    m = max(last - first - n + 1, 0)
                    start = np.flatnonzero(text[first : first + m] == text[first + n - 1 : first + n - 1 + m])
                    gram = np.full((hi + 1, len(start)), -1)  # document and words, -1 where there is none
                    gram[0] = doc[first + start]
                    for i in range(n):
                        gram[i + 1] = code[start + i]
                    grams.append(gram)
                table = pa.table([pa.array(k) for k in np.concatenate(grams, axis=1)], names=["doc", *places])
                found = table.group_by(["doc", *places], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                parts = [found[p].to_numpy() for p in places]
                spelt = [coded.dictionary.take(pa.array(p, mask=p < 0)) for p in parts]
                terms = pc.binary_join_element_wise(*spelt, " ", null_handling="skip")
                own = batch.select(keys).take(found["doc"].combine_chunks())
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, terms, found["count_all"].combine_chunks()], schema=schema
                )

    return task
