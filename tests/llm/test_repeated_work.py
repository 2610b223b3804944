"""Work that the operators on texts must not repeat, counted instead of timed."""


def test_op1_sorts_windows_without_a_lambda(spark):
    """``array_sort`` runs an interpreted comparison for every pair; ``sort_array`` gives the same order natively."""
    from sparkgas.llm.quality_rules import measures

    docs = spark.createDataFrame([(1, "a b c a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    found = measures(docs)
    assert "array_sort" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.n_repeat_words for r in found.collect()} == {1: 6, 2: 0}


def test_op10_works_out_the_loss_only_of_what_it_places(monkeypatch):
    from sparkgas.llm.packing import Limits, Packer, Part

    calls, loss = [], Part.loss
    monkeypatch.setattr(Part, "loss", lambda self, n: calls.append(n) or loss(self, n))
    packer = Packer(Limits(tokens=64, segments=8, loss_tokens=48), 0)
    for i in range(200):
        packer.add(Part(i, bytes(4 * (1 + i % 23)), 0, i % 5))
    packer.finish()
    rows = packer.take()
    assert sum(r[2] for r in rows) == sum(1 + i % 23 for i in range(200))
    assert all(sum(r[7] for r in rows if r[5] == s) <= 48 for s in {r[5] for r in rows})
    assert len(calls) <= 6 * len(rows)


def test_op11_looks_up_each_term_once():
    import numpy as np

    from sparkgas.llm.fingerprints import Signer

    class Counted(dict):
        n = 0

        def get(self, key):
            self.n += 1
            return super().get(key)

    signer, texts = Signer(), [" ".join(f"w{i % 97}" for i in range(k, k + 60)) for k in range(0, 300, 20)]
    signer.place = Counted()
    found = [signer.sign(t) for t in texts]
    assert signer.place.n == sum(len(set(t.split())) for t in texts)
    tight = Signer(known=64 * 4)  # forgets all of them every few texts
    assert all(np.array_equal(a, tight.sign(t)) for a, t in zip(found, texts))
