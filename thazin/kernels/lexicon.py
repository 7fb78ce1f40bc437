"""The word list: closed classes, seed words, and loading of further lists."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from thazin.kernels.text import normalize, tokens

# Closed classes.
POSTPOSITIONS = ["က", "ကို", "မှာ", "မှ", "၌", "တွင်", "အား", "သို့", "ဖြင့်", "နှင့်", "နဲ့", "ရဲ့", "၏", "ကတော့"]
CONJUNCTIONS = ["သို့မဟုတ်", "ဒါပေမယ့်", "ဒါမှမဟုတ်", "ဘာဖြစ်လို့လဲဆိုတော့", "ထိုနည်းတူ", "ထို့ကြောင့်", "သို့သော်", "ပြီးတော့", "လျှင်", "သလို", "ပေမဲ့"]
FINITE = ["သည်", "တယ်", "မည်", "ပြီ", "လား", "မလား"]
FINAL = [*FINITE, "၏"]
CONTINUATIONS = ["ဟု", "ဟူ", "လို့", "ဆို", "ဆိုပြီး"]
VERB_SUFFIXES = ["သည်", "တယ်", "ခဲ့", "နေ", "ပေး", "ရ", "လိုက်", "ပစ်", "ထား", "ဖူး", "မည်", "ရန်", "စေ", "ပါ", "ကြ"]
AUXILIARIES = ["နေ", "ခဲ့", "ထား", "ပေး", "လိုက်", "ပစ်", "ဖူး"]
NEGATION = "မ"
NOUN_SUFFIXES = ["များ", "တွေ", "မှု", "ချက်", "ခြင်း", "ရေး"]
FROZEN = [("သ", "လို"), ("က", "တော့"), ("ဆို", "တဲ့"), ("ပေ", "မဲ့"), ("ဒါ", "ပေ", "မယ့်"), ("သော", "ကြော", "င့်"), ("သို့", "သော်")]
NUMERALS = ["တစ်", "နှစ်", "သုံး", "လေး", "ငါး", "ခြောက်", "ခုနစ်", "ရှစ်", "ကိုး", "ဆယ်", "ရာ", "ထောင်", "သောင်း", "သိန်း", "သန်း", "ကုဋေ"]
CLASSIFIERS = ["ယောက်", "ခု", "ကောင်", "စုံ", "အုပ်", "ခွက်", "လုံး", "ပါး", "ချပ်", "ထည်", "ပေါင်", "မိုင်", "ကီလို", "မီတာ", "နာရီ", "ရက်", "လ", "နှစ်"]
TAGS = ["PUNCT", "SB", "POSTP", "SFP", "PART", "AUX", "CONJ", "PRON", "NUM", "ADV", "ADJ", "VERB", "NOUN", "ABB", "INTJ", "FW", "IDIOM", "UNK"]  # in order of preference

# Seed words by tag.
SEED = {
    "NOUN": ["မြန်မာ", "စာ", "စာပေ", "စာအုပ်", "ကျောင်း", "ကျောင်းသား", "ကျောင်းသူ", "အိမ်", "လမ်း", "ရေ", "နေ", "လ", "ခြင်း", "မှု", "သူ", "လူ", "ကလေး", "မိန်းကလေး", "ယောက်ျား", "မိန်းမ", "ခွေး", "ကြောင်", "ငှက်", "ပန်း", "သစ်ပင်", "နိုင်ငံ", "မြို့", "ရွာ", "ပြည်", "ခေါင်း", "လက်", "ခြေ", "နှလုံး", "အစာ", "ဟင်း", "ဆန်", "အသား", "ငါး", "ပေ", "ဆရာ", "ဆရာမ", "သွား"],
    "VERB": ["ဖတ်", "စား", "သောက်", "သွား", "လာ", "ကျ", "ရ", "ပြော", "ဟော", "ဖွင့်", "ပိတ်", "ရေး", "ဖွဲ့", "စီစဉ်", "လုပ်", "ဆောင်", "ရှိ", "ဖြစ်", "ပြုလုပ်", "ထား", "ယူ", "ပေး", "နေ", "စမ်း", "သပ်", "ကစား", "ခံစား"],
    "ADJ": ["ကြီး", "ငယ်", "လှ", "ရှည်", "တို", "ကောင်း", "ဆိုး", "မြင့်", "နိမ့်", "လွယ်", "ခက်", "သစ်", "ဟောင်း", "ပို"],
    "PRON": ["ကျွန်တော်", "ကျွန်မ", "သူ", "သူမ", "ဒီ", "ဟို", "အဲဒီ", "ဘယ်သူ", "ဘယ်", "အားလုံး", "ကိုယ်", "မိမိ", "ငါ", "မင်း"],
    "ADV": ["အရမ်း", "အလွန်", "သိပ်", "တော်တော်", "မကြာခဏ", "အမြဲ", "ဘယ်တော့မှ", "ပို"],
    "PART": ["များ", "တွေ", "ပါ", "ကြ", "မ"],
    "SFP": ["သည်", "တယ်", "မည်", "ပြီ", "လား", "မလား", "၏", "ပါတယ်", "ပါဘူး"],
    "AUX": ["နေ", "ထား", "ခဲ့", "ပေး", "လိုက်", "ပစ်", "ဖူး"],
}
# Words whose tags replace what the lists say.
OVERRIDES = {
    "သွား": ["VERB", "NOUN"], "ထား": ["VERB", "AUX"], "ပို": ["ADV", "ADJ"], "က": ["POSTP", "PART", "CONJ"], "သည်": ["SFP", "PART"], "တယ်": ["SFP", "PART"], "မည်": ["SFP", "PART"], "ပြီ": ["SFP", "PART"],
    "ပါတယ်": ["SFP"], "ပါဘူး": ["SFP"], "ချင်ပါတယ်": ["SFP"], "နေ": ["VERB", "NOUN", "AUX"], "မ": ["PART"], "အား": ["POSTP", "NOUN"], "နှင့်": ["POSTP", "CONJ"], "နဲ့": ["POSTP", "CONJ"], "၏": ["POSTP", "PART"],
}


class LexiconError(ValueError):
    """A word list or one of its entries is invalid."""


class Lexicon:
    """Words with their tags in order of preference; immutable, so that it can be shared with tasks."""

    def __init__(self, entries: dict[str, Iterable[str]]):
        self.entries: dict[str, tuple[str, ...]] = {}
        self.memo: dict[str, set[str]] = {}  # candidates of words seen
        for word, tags in entries.items():
            key = normalize(word)
            if not key:
                continue
            if any(c.isspace() for c in key):
                raise LexiconError(f"a word must not contain white space: {word!r}")
            known = [t for t in tags if t in TAGS]
            if not known or len(known) != len(list(tags)):
                raise LexiconError(f"unknown or missing tags of {word!r}: {list(tags)}")
            self.entries[key] = tuple(sorted({*known, *self.entries.get(key, ())}, key=TAGS.index))
        self.reach: dict[str, int] = {}  # syllables of the longest word by its first syllable
        for w in self.entries:
            parts = tokens(w)
            self.reach[parts[0][0]] = max(self.reach.get(parts[0][0], 1), len(parts))
        self.max_syllables = max(self.reach.values(), default=1)

    @classmethod
    def seed(cls) -> Lexicon:
        merged: dict[str, list[str]] = {}
        lists = [*SEED.items(), ("POSTP", POSTPOSITIONS), ("CONJ", CONJUNCTIONS), ("NUM", NUMERALS)]
        for tag, words in lists:
            for w in words:
                merged.setdefault(w, []).append(tag)
        return cls(merged | OVERRIDES)

    @classmethod
    def default(cls, folder: str | None = None) -> Lexicon:
        """The seed and every JSON list of a folder, in order of name; the fixed overrides replace what those say of a word."""
        merged = cls.seed()
        for path in sorted(Path(folder).glob("*.json")) if folder else ():
            merged = merged.merged(cls.from_file(str(path)))
        return cls(merged.entries | OVERRIDES)

    @classmethod
    def from_file(cls, path: str, merge: bool = False) -> Lexicon:
        """A JSON object of lists, or lines of word<TAB>tag,tag with # comments; a byte order mark is allowed."""
        text = Path(path).read_text(encoding="utf-8-sig")
        if path.endswith(".json"):
            try:
                data = json.loads(text)
            except ValueError as e:
                raise LexiconError(f"no JSON: {path}") from e
            if not isinstance(data, dict) or not all(isinstance(v, list) for v in data.values()):
                raise LexiconError("expected an object of lists")
        elif path.endswith(".txt"):
            data = {}
            for line in text.splitlines():
                if line.strip() and not line.startswith("#"):
                    word, sep, tags = line.partition("\t")
                    if not sep:
                        raise LexiconError(f"expected word<TAB>tags: {line!r}")
                    data.setdefault(word.strip(), []).extend(t.strip() for t in tags.split(",") if t.strip())
        else:
            raise LexiconError(f"unknown kind of file: {path}")
        loaded = cls(data)
        return cls.seed().merged(loaded) if merge else loaded

    def with_word(self, word: str, tags: Iterable[str]) -> Lexicon:
        """A lexicon that holds a word, with these tags besides those it has."""
        return self.merged(Lexicon({word: tags}))

    def merged(self, other: Lexicon) -> Lexicon:
        return Lexicon({w: [*self.entries.get(w, ()), *other.entries.get(w, ())] for w in {*self.entries, *other.entries}})

    def save(self, path: str) -> None:
        part = Path(path + ".part")
        part.write_text(json.dumps({w: list(t) for w, t in sorted(self.entries.items())}, ensure_ascii=False, indent=1), encoding="utf-8")
        part.replace(path)

    def __contains__(self, word: str) -> bool:
        return word in self.entries

    def tags(self, word: str) -> tuple[str, ...]:
        return self.entries.get(word, ())
