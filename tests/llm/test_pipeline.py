from collections import defaultdict

import corpus_pipeline
from lanepulse.llm import packing, repetition, secrets
from test_bpe_packing import check_packing
from test_lines import plain as plain_lines
from test_secrets import plain as plain_secrets
from test_simhash import plain_components, plain_print
from tokenizers import Tokenizer


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = now = stage(spark, docs, sf_dir)
        if name != "packing":
            assert now.columns == docs.columns
            docs = now = now.checkpoint()
            out[name] = {r.doc_id: r.text for r in now.collect()}
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i: t for i, t in first.items() if repetition.measure(t)[8]}
    assert out["quality_rules"] == kept and 0.8 * len(first) < len(kept) < len(first)

    gone = defaultdict(set)
    for d, at in plain_lines(sorted(kept.items())):
        gone[d].add(at)
    lines = {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i]) for i, t in kept.items()}
    assert out["line_dedup"] == lines

    head = plain_components([(i, plain_print(t)) for i, t in lines.items()])
    single = {i: t for i, t in lines.items() if head[i] == i}
    assert out["simhash_dedup"] == single and len(single) < len(lines)

    for i, text in out["secret_masks"].items():
        assert not plain_secrets(text)
        if not plain_secrets(single[i]) and secrets.MASK not in text:
            assert text == single[i]
    assert out["secret_masks"].keys() == single.keys()
    assert any(secrets.MASK in t for t in out["secret_masks"].values())

    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, packing.END] for i, t in out["secret_masks"].items()}
    check_packing(out["packing"].collect(), ids)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 0


def test_odd_tables_pass_every_stage(spark, sf_dir):
    long_text = "\n".join(f"word{i} and others of line {i} password=abcdef0123456789" for i in range(400))
    rows = [(None, None, 1, "a"), (1, None, 2, None), (2, "", 3, "x"), (2, "", 3, "x"), (3, " \n\t ", 4, "y"), (None, long_text, 5, None),
            (4, long_text + " end", 6, "z"), (5, " ".join(f"t{i}" for i in range(3000)), 7, "k"), (5, " ".join(f"t{i}" for i in range(3000)), 7, "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, d int, kept string").withColumnsRenamed({"kept": "_doc"})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == odd.columns
                docs = out.checkpoint()
        assert (out.count() > 0) == (docs.count() > 0)
