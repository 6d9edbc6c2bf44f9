"""Command line: ``python -m tunedata <command> <input> <output> [...]``.

    tmx-to-sft         TMX_DIR OUT              training prompt/completion JSON lines
    tmx-to-validation  TMX_DIR OUT [MAX_TUS]    src/tgt/lang JSON lines (first units per file)
    fix-lang-codes     IN OUT                   two-letter language codes
    split              IN TRAIN_OUT VALID_OUT   seeded exact 80/20 split (key: path, tu_idx, lang_pos)
    flatten            IN OUT                   {"text": "... Output: ..."}
    tokenise           IN OUT [MODE]            fixed-length id/label arrays (Parquet by split)

The session comes from ``SparkSession.builder.getOrCreate()`` (spark-submit settings apply).
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tunedata.plans import jobs


def main(argv: list[str]) -> int:
    if len(argv) < 3 or argv[0] not in jobs.COMMANDS:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName(f"tunedata {argv[0]}").getOrCreate()
    cmd, args = argv[0], argv[1:]
    if cmd == "tmx-to-validation" and len(args) > 2:
        jobs.tmx_to_validation_set(spark, args[0], args[1], max_tus=int(args[2]))
    elif cmd == "split":
        jobs.split_dataset(spark, args[0], args[1], args[2])
    elif cmd == "tokenise" and len(args) > 2:
        jobs.tokenise_dataset(spark, args[0], args[1], mode=args[2])
    else:
        jobs.COMMANDS[cmd](spark, args[0], args[1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
