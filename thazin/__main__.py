"""Command line: analyse lines of text files, or score a segmentation, and write the result as JSON lines.

    python -m thazin MODE INPUT OUTPUT [--dictionary FILE] [--entities FOLDER]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thazin.api import Analyzer
from thazin.functions import native
from thazin.kernels.lexicon import LexiconError
from thazin.kernels.repair import MarkovModel
from thazin.operators import evaluation, text
from thazin.sources import export

MODES = ("syllables", "words", "pos", "sentences", "all", "zg2uni", "uni2zg", "to-unicode", "bench", "fertility")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    nlp = Analyzer(dictionary_path=args.dictionary, entities=args.entities or ())
    lines = spark.read.text(args.input).withColumnRenamed("value", "text")
    t = F.col("text")
    if args.mode == "syllables":
        return lines.select(nlp.syllables(t).alias("syllables"))
    if args.mode == "words":
        return nlp.words(lines, "text").select("words")
    if args.mode == "pos":
        return nlp.tags(nlp.words(lines, "text"), "words").select("words", "tags")
    if args.mode == "sentences":
        return nlp.sentences(lines, "text").select("sentences")
    if args.mode == "all":
        return nlp.process(lines, "text").select("document.*")
    if args.mode == "zg2uni":
        return lines.select(native.legacy_to_standard(t).alias("text"))
    if args.mode == "uni2zg":
        return lines.select(native.standard_to_legacy(t).alias("text"))
    if args.mode == "to-unicode":
        return text.standardized(lines, "text", MarkovModel.read(args.model)).select(F.col("standard").alias("text"))
    if args.mode == "fertility":
        m = evaluation.ratios(evaluation.measured(lines.withColumn("k", F.lit("all")), "text", lexicon=nlp.lexicon), "utf8_bytes")
        return evaluation.distribution(m, "tokens_per_word", "k").drop("k")
    gold = export.gold_compounds(spark.read.text(args.input)) if args.pipe else export.gold_lines(spark.read.text(args.input))
    rows = evaluation.numbered(gold.select(evaluation.canonical_words(F.col("words")).alias("gold"), "raw_line"), "raw_line", out="id")
    hyp = nlp.words(rows.withColumn("t", F.array_join("gold", "")), "t", "hyp")
    lexicon = spark.createDataFrame([(w,) for w in nlp.lexicon.entries], "word string")
    return evaluation.report(hyp, "id", "gold", "hyp", lexicon)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="thazin", description=__doc__)
    p.add_argument("mode", choices=MODES)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--dictionary")
    p.add_argument("--entities")
    p.add_argument("--model", help="the binary model for to-unicode")
    p.add_argument("--pipe", action="store_true", help="gold lines join the parts of compounds by |")
    args = p.parse_args(argv)
    if args.mode == "to-unicode" and not args.model:
        p.error("to-unicode needs --model")
    try:
        spark = SparkSession.builder.appName("thazin").getOrCreate()
        run(spark, args).write.json(args.output)
    except LexiconError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
