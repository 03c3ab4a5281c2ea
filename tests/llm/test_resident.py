"""A Python worker holds one model at a time."""

import weakref

from sqlrun.llm import resident as holder
from sqlrun.llm.resident import resident


class Model:
    pass


def test_a_model_stays_until_another_is_asked_for():
    holder._held.clear()
    made = []

    def make():
        made.append(Model())
        return made[-1]
    first = resident(("a", 1), make)
    assert resident(("a", 1), make) is first and len(made) == 1
    gone = weakref.ref(first)
    del first
    made.clear()
    second = resident(("b", 1), make)
    assert gone() is None and list(holder._held) == [("b", 1)] and made == [second]


def test_a_worker_that_went_through_the_stages_holds_the_last_ones_model(spark, docs, tmp_path):
    """After language ID and encoding in the same workers, only the encoder is held."""
    import pyarrow as pa

    from sqlrun.llm.bpe import encode_documents
    from sqlrun.llm.language_id import identify
    from sqlrun.llm.queries import BYTE_BPE, tokenizer_path

    identify(docs, docs.doc_id % 2 == 0).count()
    encode_documents(docs, tokenizer_path(BYTE_BPE)).count()

    def held(batches):
        from sqlrun.llm import resident as own
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"held": [",".join(sorted(k[0] for k in own._held))]})
    seen = {r.held for r in docs.select("doc_id").mapInArrow(held, "held string").collect()}
    assert seen <= {"", "bpe", "languages"} and "bpe" in seen
