"""What the language model leaves on disk."""

import time
from pathlib import Path
from urllib.parse import urlparse

from episodica.llm import kneser_ney


def test_language_model_takes_little_disk(spark):
    """Chunks are told numbers, no hashes, and shuffles go once they are read; sorted hashes with their counts were larger than the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    shared = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    models, held = set(shared.glob("language-model-*")), shuffled()
    kneser_ney.score(docs, 3, 300_000, 600_000)
    (made,) = set(shared.glob("language-model-*")) - models
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert sum(f.stat().st_size for f in made.rglob("*") if f.is_file()) < text / 2
    for _ in range(50):  # files go in the background
        left = sum(Path(f).stat().st_size for f in shuffled() - held if Path(f).exists())
        if left < text / 10:
            break
        time.sleep(0.1)
    assert left < text / 10
