"""The corpus pipeline against its stages done by brute force."""

import hashlib

import corpus_pipeline
from lernwerk.llm import bpe, mixing, quality
from lernwerk.llm.common import Shared

from .conftest import SF, prose
from .test_operators import SPACE, brute_groups, brute_measures


def without_frequent(texts, least=10):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    count = {}
    for t in texts:
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < least) for t in texts]


def test_pipeline_equals_brute_force(spark, table):
    from tokenizers import Tokenizer

    docs = [(i, "\n".join([prose(i, 60 + i), "All Rights Reserved.", prose(i + 500, 20)]), f"s{i % 3}") for i in range(40)]
    docs += [(100 + i, docs[i][1] + " more", docs[i][2]) for i in range(10)] + [(200 + i, docs[5][1], "s0") for i in range(12)]
    docs += [(300, "too short", "s1"), (301, None, "s1"), (302, "again and again " * 40, "s2")]
    shared = Shared(spark)
    table(*docs).write.parquet(f"{shared.root}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, shared.root).collect()}

    kept = [(i, t, s) for i, t, s in docs if (m := brute_measures(t))[0] >= quality.MIN_WORDS and 100 * m[4] <= 50 * m[0]]
    texts = without_frequent([t for _, t, _ in kept])
    kept = [(i, t, s) for (i, _, s), t in zip(kept, texts)]
    groups = brute_groups([(i, t) for i, t, _ in kept])
    kept = [(i, t, s) for i, t, s in kept if groups[i][1] == i]
    rows = spark.createDataFrame([(i, t, "en", s, len([d for d in docs if d[0] == i][0][1])) for i, t, s in kept], table().schema)
    drawn = {r.doc_id: r.text for r in mixing.stage(spark, rows, shared.root).collect()}
    ref = Tokenizer.from_file(bpe.word_file())
    assert set(got) == set(drawn) and 0 < len(got) < len(kept)
    for i, text in drawn.items():
        ids = ref.encode(text, add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, table):
    for docs in (odd, table()):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            out = Shared(spark).put(stage(spark, now, SF))
            if name != "bpe":
                assert out.columns == docs.columns and out.count() <= now.count(), name
            now = out
    assert now.isEmpty()
