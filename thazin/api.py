"""One object that holds the dictionaries and analyses columns of text with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thazin.functions import native
from thazin.kernels import analysis
from thazin.kernels import text as kernels
from thazin.kernels.entities import Entities
from thazin.kernels.grammar import Grammar
from thazin.kernels.lexicon import Lexicon
from thazin.operators import evaluation, text
from thazin.session import mapped, shared

WordEngine = Callable[[str, Lexicon], list[str]]
TagEngine = Callable[[list[str], Lexicon], list[str]]
WORD_ENGINES: dict[str, WordEngine] = {"longest": lambda t, lex: [w[0] for w in analysis.words(kernels.normalize(t), lex)]}
TAG_ENGINES: dict[str, TagEngine] = {"rule": lambda words, lex: analysis.pos_tags(words, lex)}


def _engine(engines: dict, name: str):
    if name not in engines:
        raise ValueError(f"unknown engine {name!r}; there are {sorted(engines)}")
    return engines[name]


class Analyzer:
    """Dictionaries and options; each method adds a column to a DataFrame and works on streams too.

    ``lexicon`` or ``dictionary_path`` (united with the seed) give the words,
    ``entities`` the names as (name, kind, attributes) or a folder of lists,
    ``units`` the multi-word units.  Without ``soft_sentences`` only stops end
    sentences.  An analyzer isn't changed: ``with_...`` return a new one.
    """

    def __init__(self, lexicon: Lexicon | None = None, dictionary_path: str | None = None, entities: Iterable | str = (), units: Iterable = (), grammar: Grammar | None = None, soft_sentences: bool = True):
        if lexicon is not None and dictionary_path is not None:
            raise ValueError("give a lexicon or a path, not both")
        self.lexicon = lexicon or (Lexicon.from_file(dictionary_path, merge=True) if dictionary_path else Lexicon.seed())
        self.entities = self._loaded(entities) if isinstance(entities, str) else list(entities)
        self.units, self.grammar, self.soft = list(units), grammar, soft_sentences

    def _loaded(self, path: str) -> list:
        return [e for es in Entities.load(path, self.lexicon).by_text.values() for e in es]

    def _with(self, **changes) -> Analyzer:
        kept = {"lexicon": self.lexicon, "entities": self.entities, "units": self.units, "grammar": self.grammar, "soft_sentences": self.soft}
        return Analyzer(**(kept | changes))

    def with_word(self, word: str, tags: Iterable[str]) -> Analyzer:
        return self._with(lexicon=self.lexicon.with_word(word, tags))

    def with_units(self, path: str) -> Analyzer:
        loaded = analysis.Units.from_file(path, self.lexicon)
        return self._with(units=[*self.units, *((k, category, priority) for k, (priority, category) in loaded.by.items())])

    def with_entities(self, path: str) -> Analyzer:
        return self._with(entities=[*self.entities, *self._loaded(path)])

    def save_dictionary(self, path: str) -> None:
        self.lexicon.save(path)

    def syllables(self, col: Column) -> Column:
        return native.syllables(native.visible(text.normalized(col)))

    def words(self, df: DataFrame, col: str, out: str = "words", engine: str = "longest") -> DataFrame:
        """Adds the words of a text by an engine; multi-word units aren't merged."""
        run, handle = _engine(WORD_ENGINES, engine), shared(df.sparkSession, self.lexicon)
        return df.withColumn(out, mapped(lambda t: run(t, handle.value[1]), "array<string>", F.col(col)))

    def tags(self, df: DataFrame, words: str, out: str = "tags", engine: str = "rule") -> DataFrame:
        """Adds one tag for each given word."""
        run, handle = _engine(TAG_ENGINES, engine), shared(df.sparkSession, self.lexicon)
        return df.withColumn(out, mapped(lambda ws: run([w or "" for w in ws], handle.value[1]), "array<string>", F.col(words)))

    def sentences(self, df: DataFrame, col: str, out: str = "sentences") -> DataFrame:
        """Adds the sentences with their offsets in the normalized text and their words."""
        return self.process(df, col, "_doc").withColumn(out, F.col("_doc.sentences")).drop("_doc")

    def phrases(self, df: DataFrame, words: str, tags: str, out: str = "chunks") -> DataFrame:
        """Adds the phrases over given words and tags; no units, entities or locked tags."""
        handle = shared(df.sparkSession, self.grammar)
        kind = "array<struct<type: string, text: string, first: int, last: int>>"
        return df.withColumn(out, mapped(lambda w, t: [dict(zip(("type", "text", "first", "last"), c)) for c in analysis.chunks(list(w), list(t), (), handle.value[1])], kind, F.col(words), F.col(tags)))

    def chunk(self, df: DataFrame, col: str, out: str = "chunks") -> DataFrame:
        """Adds the phrases of a text, with entities found without tags and not locked into them, and without units."""
        handle = shared(df.sparkSession, (self.entities, self.lexicon, self.grammar))

        def run(t: str) -> list[dict]:
            from thazin.session import built

            finder = built(handle, _finder)
            _, lexicon, grammar = handle.value[1]
            seq = WORD_ENGINES["longest"](t, lexicon)
            locked = [(h.first, h.last) for h in finder.find(seq)]
            return [dict(zip(("type", "text", "first", "last"), c)) for c in analysis.chunks(seq, analysis.pos_tags(seq, lexicon), locked, grammar)]

        return df.withColumn(out, mapped(run, "array<struct<type: string, text: string, first: int, last: int>>", F.col(col)))

    def process(self, df: DataFrame, col: str, out: str = "document") -> DataFrame:
        return text.processed(df, col, self.lexicon, self.units, self.entities, out, self.grammar, self.soft)

    def records(self, df: DataFrame, col: str, out: str = "records") -> DataFrame:
        return text.recorded(df, col, self.lexicon, self.units, self.entities, out, self.grammar, self.soft)

    def stats(self, df: DataFrame, col: str, out: str = "stats") -> DataFrame:
        return self.process(df, col, "_doc").withColumn(out, text.stats(F.col("_doc"))).drop("_doc")

    def features(self, df: DataFrame, id_col: str, col: str) -> DataFrame:
        return evaluation.syllable_features(df, id_col, col)


def _finder(value: tuple) -> Entities:
    return Entities(value[0], value[1])
