import random

import corpus_pipeline
from quoin.llm.pii import all_spans, fit_trees, redacted
from quoin.llm.toxicity import fit_grammar
from test_decontaminate import brute as brute_passages
from test_ngram_join import brute as brute_classes


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    words = [f"w{k}er" for k in range(300)]
    fresh = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(k, " ".join(fresh(30))) for k in range(5)]
    rows, labels = [], []
    for i in range(260):
        text = fresh(rnd.choice([4, 40, 120]))
        if i % 6 == 1:
            for _ in range(3):
                text.insert(rnd.randint(0, len(text)), rnd.choice(["dreckling", "muckface"]))
        elif i % 6 == 2:
            text[2:2] = rnd.choice(items)[1].split(" ")
        elif i % 6 == 3:
            text += ["a.b@c.org", "+1", "555", "123", "4567"]
        elif i % 6 == 4 and i > 60:
            text = (rows[rnd.randrange(40)][1] or "").split(" ")
        rows.append((i, " ".join(text), "en", "s", 7))
        labels.append((i, 1, int(i % 6 == 1)))
    rows += [(400, None, "en", "s", None), (401, "", None, None, 0), (402, "a lone text", "en", "s", 1), (402, "a lone text", "en", "s", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    now = {r[0]: r[1] for r in rows}
    grammar = fit_grammar(docs, spark.read.parquet(f"{path}/labels.parquet"))
    automaton = grammar.automaton()
    want = [{i: t for i, t in now.items() if grammar.score(grammar.events(t or "", automaton)) < 0.5}]
    classes = brute_classes(sorted(want[-1].items()))
    want.append({i: t for i, t in want[-1].items() if classes[i][1] == i})
    leaks = {d for d, _ in brute_passages(want[-1].items(), items)}
    want.append({i: t for i, t in want[-1].items() if i not in leaks})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "pii":
            model = fit_trees(docs)
            want.append({i: t if t is None else redacted(t, all_spans(t, model)) for i, t in want[-1].items()})
        got = stage(spark, docs, path)
        if k < 4:
            assert got.columns == docs.columns
            got.write.parquet(f"{path}/stage{k}")
            docs = spark.read.parquet(f"{path}/stage{k}")
            found = {r.doc_id: r.text for r in docs.collect()}
            assert found == want[k], name
            assert (docs.count() == len(found)) == (k > 0)
    assert {r.doc_id for r in got.collect()} == set(want[3])
    assert len(want[0]) < 240 and len(want[1]) < len(want[0]) - 10 and len(want[2]) < len(want[1]) - 10 and want[3] != want[2]
