"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, self, copula, negation, report, other); sentences end at full stops, and
commas and colons part their clauses. Five small machines read a sentence from each side: *insult* (is it set off by
commas), *threat* (whom it is aimed at), *target* (is someone addressed nearby), *negation* and *reported speech*. ``compose``
builds the product of each side's five once, state by state, so a sentence costs two table steps a word, and what an insult
or a threat is worth follows from the states on both of its sides: an insult that meets someone ("you are an idiot",
"idiot like you") or calls out to someone (", idiot") more than one that merely occurs; a threat with someone as its object
("kill you", "you I will kill") more than one with none ("kill the lights", "hurt my knee"); less in the scope of a negation,
of either side but of the same clause, and less in a sentence that reports what was said. Only sentences with an insult or
a threat are run. The score is
1 - (1 - base) * exp(-evidence), where a document's evidence is the sum over its matched words, if it has at most ``PASSAGE``
words. In a text of r times as many words a chance match is r times as likely. There a word gives ``FIXED_EVIDENCE`` at most,
and the evidence is the greater of that of the whole, whose k matches are worth log(r^k / k!) less, and that of the passage
of ``PASSAGE`` words with most of it, worth log(r) less. So one stray word, whatever it is, decides no long text; enough
of them, or an abusive passage in a clean text, do.

Evidence is learned from labelled rows that aren't held out: at most ``SAMPLE`` of them, those of least hash of the id.
A word of any length, or a beginning of words, becomes an insult if it stands in so many different contexts of toxic rows
(copies of one text count once) and so few clean rows that of all that are learned chance explains a twentieth at most
(Benjamini and Hochberg's rule over all words tried): no bound on how many are learned but the sample's size. A fixed list of common English insults and threats is kept beside it.

Defined results: null, empty and wordless texts score ``base``; a label row without document, or null labels, teach
nothing; several labels of a document count as the highest; without any label the fixed list alone is used; repeated rows
each get a row; texts are read whole; labels, lang, source and doc_id are never inputs of a score; ``reject`` keeps the
values of all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, held_out, unused
from .components import written

#: Most labelled rows that are learned from.
SAMPLE = 20_000
#: A document with at least this score is toxic.
THRESHOLD = 0.7
#: A learned insult stands in so many contexts at least, with this share of toxic rows; chance may explain so many of those learned.
LEAST_CONTEXTS, LEAST_PRECISION, CHANCE = 3, 0.75, 0.05
#: Words of a text up to which a match counts in full. From 60 to 120 the labelled rows of sf0.1 are told apart about equally well.
PASSAGE = 100
PREFIXES = (4, 5, 6)

# The word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile dumbass bastard asshole bitch".split()
THREATS = "kill hurt destroy stab shoot murder strangle beat töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your u ur you're you'll he she they him her them du dich ihr dir tu toi vous te ti usted ustedes".split()
SELVES = "i i'm i'll me my mine myself we us our ich mir mich mein wir uns je moi mon nous yo mi nosotros".split()
COPULAS = "am are is was were be being r bist ist seid sind es est êtes sont eres son".split()
NEGATIONS = "not never isn't aren't don't won't wasn't nobody nicht kein keine jamais nunca jamás".split()
REPORTS = "said says wrote writes quoted quote reported claimed called sagte schrieb dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, SELF, COPULA, NEGATION, REPORT, COMMA, END = range(10)
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.,;:!?\n]")
#: What the evidence of a word is multiplied by.
AIMED, CALLED, BARE, AIMED_THREAT, UNAIMED_THREAT, NEGATED, REPORTED = 1.5, 1.2, 0.5, 1.0, 0.15, 0.3, 0.35
#: Words that a target (before, after), a threat's object and a negation (before, after) reach over.
TARGET_BEFORE, TARGET_AFTER, OBJECT_AFTER, NEGATION_BEFORE, NEGATION_AFTER = 3, 2, 3, 3, 2
FIXED_EVIDENCE = 2.0


def insult_fst(state: int, symbol: int) -> int:
    """What is next on this side: 0 a word, 1 the sentence's edge, 2 a comma."""
    return 2 if symbol == COMMA else 0


def agent_fst(state: int, symbol: int) -> int:
    """Before a threat: 1 someone has been named, 2 and then oneself ("you I will ...")."""
    if symbol in (COMMA, TARGET):
        return int(symbol == TARGET)
    return 2 * (state > 0) if symbol == SELF else state


def counting(start_at: int, reach: int, keeps: tuple[int, ...], stops: tuple[int, ...], lifted: bool = False):
    """A symbol that reaches over so many words; ``keeps`` don't count, ``stops`` end it, and so does a second one if lifted."""

    def fst(state: int, symbol: int) -> int:
        if symbol == start_at:
            return 0 if lifted and state else reach
        return 0 if symbol in stops else state if symbol in keeps else max(0, state - 1)

    return fst


def report_fst(state: int, symbol: int) -> int:
    return int(state or symbol == REPORT)


#: The machines of each side (insult, threat, target, negation, report); those of the right side read from the sentence's end.
LEFT = (insult_fst, agent_fst, counting(TARGET, TARGET_BEFORE, (COPULA, INSULT), (COMMA, REPORT)), counting(NEGATION, NEGATION_BEFORE, (), (COMMA,), True), report_fst)
RIGHT = (insult_fst, counting(TARGET, OBJECT_AFTER, (), (COMMA, SELF)), counting(TARGET, TARGET_AFTER, (COPULA, INSULT), (COMMA, REPORT)), counting(NEGATION, NEGATION_AFTER, (), (COMMA,)), report_fst)
START = (1, 0, 0, 0, 0)


def compose(machines: tuple) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """The product of one side's machines: its states, and the next one by state and symbol."""
    number, queue, step = {START: 0}, [START], []
    for state in queue:
        step.append([])
        for symbol in range(END):
            after = tuple(f(s, symbol) for f, s in zip(machines, state))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            step[-1].append(number[after])
    return queue, step


def factor(symbol: int, left: tuple[int, ...], right: tuple[int, ...]) -> float:
    """What a word's evidence is multiplied by, from the states of the machines before and after it."""
    (l_edge, l_threat, l_target, l_negation, l_report), (r_edge, r_threat, r_target, r_negation, r_report) = left, right
    if symbol == INSULT:
        called = l_edge and r_edge and 2 in (l_edge, r_edge)
        out = AIMED if l_target or r_target else CALLED if called else BARE
    else:
        out = AIMED_THREAT if r_threat or l_threat == 2 else UNAIMED_THREAT
    return out * (NEGATED if l_negation or r_negation else 1.0) * (REPORTED if l_report or r_report else 1.0)


LEFT_STATES, LEFT_STEP = compose(LEFT)
RIGHT_STATES, RIGHT_STEP = compose(RIGHT)


@cache
def composed_factor(symbol: int, left: int, right: int) -> float:
    return factor(symbol, LEFT_STATES[left], RIGHT_STATES[right])


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    base: float = 0.05

    def __post_init__(self):
        kinds = ((TARGETS, TARGET), (SELVES, SELF), (COPULAS, COPULA), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT))
        self.symbols = {w: k for words, k in kinds for w in words}
        self.evidence = dict.fromkeys(INSULTS + THREATS, FIXED_EVIDENCE) | {w: e for w, e in self.words.items() if self.symbols.get(w, INSULT) in (INSULT, THREAT)}
        self.symbols |= {w: INSULT for w in self.words if w not in self.symbols}
        self.symbols |= dict.fromkeys(",:", COMMA) | dict.fromkeys(".;!?\n", END)
        self.seen: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        if word in self.symbols:
            return self.symbols[word]
        for n in PREFIXES:
            if len(word) >= n and word[:n] in self.prefixes:
                self.symbols[word], self.evidence[word] = INSULT, max(self.prefixes.get(word[:k], 0.0) for k in PREFIXES)
                return INSULT
        return OTHER

    def read(self, text: str | None) -> tuple[float, int, int]:
        """(score, clauses, sentences with a match)."""
        if not text:
            return self.base, 0, 0
        tokens = TOKEN.findall(text.lower())
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen, classes = self.seen, []
        for w in tokens:
            c = seen.get(w)
            if c is None:
                c = seen[w] = self.symbol(w)
            classes.append(c)
        marks = classes.count(END) + classes.count(COMMA)
        hits, matched = [], 0
        if INSULT in classes or THREAT in classes:
            a, before = 0, 0  # of the sentence; words before it
            for b in [*(i for i, c in enumerate(classes) if c == END), len(classes)]:
                here = classes[a:b]
                if INSULT in here or THREAT in here:
                    found = self.sentence(tokens[a:b], here)
                    hits += [(before + i, e) for i, e in found]
                    matched += bool(found)
                before, a = before + len(here) - here.count(COMMA), b + 1
        evidence = weighed(hits, len(classes) - marks)
        return (1 - (1 - self.base) * math.exp(-evidence) if evidence else self.base), marks + 1, matched

    def sentence(self, tokens: list[str], classes: list[int]) -> list[tuple[int, float]]:
        """(place among the words, evidence) of the matched words of a sentence."""
        after, state = [], 0
        for c in reversed(classes):
            after.append(state)
            state = RIGHT_STEP[state][c]
        out, state, place = [], 0, 0
        for w, c, right in zip(tokens, classes, reversed(after)):
            if c in (INSULT, THREAT):
                out.append((place, composed_factor(c, state, right) * self.evidence[w]))
            state = LEFT_STEP[state][c]
            place += c != COMMA
        return out


def weighed(hits: list[tuple[int, float]], n_words: int) -> float:
    """The evidence of matches (place among the words, evidence), in order, in a text of so many words."""
    if n_words <= PASSAGE or not hits:
        return sum(e for _, e in hits)
    capped = [min(e, FIXED_EVIDENCE) for _, e in hits]
    more, best, here, a = math.log(n_words / PASSAGE), 0.0, 0.0, 0
    for (place, _), e in zip(hits, capped):
        here += e
        while place - hits[a][0] >= PASSAGE:
            here, a = here - capped[a], a + 1
        best = max(best, here)
    return max(0.0, best - more, sum(capped) - len(hits) * more + math.lgamma(len(hits) + 1))


def features(text: str) -> Iterator[tuple[str, int]]:
    """(word or beginning of a word, hash of the words beside it); beginnings end in ``*``."""
    words = [w for w in TOKEN.findall(text.lower()) if w[0] not in ".,;:!?\n"]
    for i, w in enumerate(words):
        context = hash_of((words[i - 1] if i else "") + " " + (words[i + 1] if i + 1 < len(words) else ""))
        yield w, context
        for n in PREFIXES:
            if len(w) > n:
                yield w[:n] + "*", context


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode()) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``(text, label)`` of the at most ``sample`` labelled rows of least hash that aren't held out, written for the passes over
    them."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return written(docs.select("doc_id", F.col("text").cast("string")).where("text is not null").join(F.broadcast(ids), "doc_id").select("text", "label"))


def by_chance(toxic: int, clean: int, share: float) -> float:
    """Bound on the log of the chance that of so many rows as many are toxic, if each is with chance ``share``."""
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if clean else 0.0))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    rows = training_rows(docs, labels, "toxic", sample)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                pairs = {p for t in column(part, "text").to_pylist() for p in features(t)}
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["f", "c"])

    n_rows, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic:
        return Grammar(base=min(0.5, 1 / (n_rows + 20)))
    share = min(n_toxic / n_rows, 0.5)
    tried = written(rows.where("label = 1").mapInArrow(contexts, "f string, c long").distinct().groupBy("f").count())
    n_tried = tried.count()
    wide = {r.f: r["count"] for r in tried.where(F.col("count") >= LEAST_CONTEXTS).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wide))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for t, y in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
                seen.update((f, y) for f in {f for f, _ in features(t)} & shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["f", "label", "n"])

    seen = {(r.f, r.label): r.n for r in rows.mapInArrow(documents, "f string, label int, n long").groupBy("f", "label").agg(F.sum("n").alias("n")).collect()}
    counts = {f: (min(seen.get((f, 1), 0), n), seen.get((f, 0), 0)) for f, n in wide.items()}
    chances = {f: by_chance(t, c, share) for f, (t, c) in counts.items() if t >= LEAST_CONTEXTS}
    bar = max((p for k, p in enumerate(sorted(chances.values()), 1) if p <= math.log(CHANCE * k / n_tried)), default=-math.inf)
    words, prefixes = {}, {}
    for f, p in chances.items():
        t, c = counts[f]
        precision = t / (t + c + 1)
        if p <= bar and precision >= LEAST_PRECISION:
            # the labels tell what it is worth as it mostly stands, bare
            (prefixes if f[-1] == "*" else words)[f.rstrip("*")] = -math.log(1 - precision) / BARE
    # a beginning that nearly always goes on in one way says no more than the longer one
    alone = lambda f: any(w.startswith(f) and wide[w] >= 0.8 * wide[f + "*"] for w in words) or any(g != f and g.startswith(f) and wide[g + "*"] >= 0.8 * wide[f + "*"] for g in prefixes)
    prefixes = {f: e for f, e in prefixes.items() if not alone(f)}
    grammar = Grammar(words, prefixes)
    # what remains toxic of the sample without a matched clause
    model = docs.sparkSession.sparkContext.broadcast(grammar)

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [model.value.read(t)[2] > 0 for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.bool_()), column(batch, "label")], ["hit", "label"])

    n, k = rows.mapInArrow(missed, "hit boolean, label int").where("not hit").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return Grammar(words, prefixes, min(0.5, (k + 1) / (n + 20)))


def scored(docs: DataFrame, grammar: Grammar, names: tuple[str, str, str] = ("toxicity", "n_clauses", "n_matched")) -> DataFrame:
    """All rows and columns of ``docs`` with the score, the number of clauses and that of matched sentences added, under these
    names; one of them in ``docs`` already is an error."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    model = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.value.read
        for batch in batches:
            for part in blocks(batch):
                found = [read(t) for t in column(part, "text").to_pylist()]
                arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    columns = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {kind}" for n, kind in zip(names, ("double", "long", "long")))]
    return docs.mapInArrow(run, ", ".join(columns))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    docs = docs.select("doc_id", F.col("text").cast("string"))
    score = F.col("toxicity")
    return scored(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "n_clauses", "n_matched")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the toxic ones, all columns kept."""
    names = tuple(unused(docs, n) for n in ("toxicity", "n_clauses", "n_matched"))
    return scored(docs, learn(docs, labels), names).where(F.col(names[0]) < THRESHOLD).drop(*names)
