"""Question and reply pairs whose reply is no proper one.

Method: a pushdown parser over fences, brackets, quotation marks, lists and markup finds replies that stop inside an
open structure; greedy string tiling between question and reply finds echoes; refusals are found by a grammar for each
language; the language of a reply is told by its script and by words, weighed by how often replies to questions in each
language use them. What punctuation can't tell about a reply that breaks off, the corpus of all replies does
(endings.py).
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.endings import ending_evidence
from evalloom.runtime import cut_lineage

DEFECTS = ("empty", "refusal", "echo", "language", "truncated")
LOW_END_RATE = 0.05
LOW_DOT_RATE = 0.1
#: A word weighs in on the language if at least one in so many replies has it; this bounds how many do.
WORD_SHARE = 5_000
#: Replies that must have a word in small letters, and one in capitals, before it weighs in.
MIN_REPLIES, MIN_REPLIES_CAPITAL = 5, 20
#: How much likelier, as a natural logarithm, another language must be.
LANGUAGE_MARGIN = 3.0
#: Shortest tile that counts as copied, and the share of both texts that tiles must cover in an echo.
MIN_TILE = 2
ECHO_SHARE = 0.9

#: Of the rolling hashes of stretches.
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003_579

_WORD = re.compile(r"[^\W_]+")

# Replies that say nothing, in lower case and without brackets, quotation marks and outer spaces.
PLACEHOLDERS = {"answer", "reply", "response", "text", "blank", "empty", "null", "nil", "none", "nan", "n/a", "na", "n.a", "tbd", "tba", "todo", "undefined", "missing", "no answer", "no response", "placeholder", "insert answer here", "xxx", "pending", "br", "p", "div", "nbsp"}

# Frequent function words of the languages told apart; they tell the language of a question.
FUNCTION_WORDS = {
    "en": "the of is in was to and at for a are has by with from on who what which when where how does can do why since its whose".split(),
    "de": "der die das ist in von und im am zu für wurde nach mit den dem wie was wo wer wann darf man welche welchem seit nicht ein eine".split(),
    "fr": "le la les de du est à au et en dans pour qui que quelle quelles quel où quand peut combien pourquoi depuis se un une il t".split(),
    "es": "el la los las de es en y del para qué quién cuándo dónde se por cuál cuántas cuánto desde una un su a al fue pueden".split(),
}

# The refusal grammars, one a language. A production is a sequence of words and <symbols>; "..." skips words
# of the same sentence, "?" after a part makes it optional, "-" before one joins it to the part before, "~" stands for the
# ending of a word.
GRAMMARS = {
    "en": {
        "refusal": ["<i> <unable> ... <act>", "<i> <will>? <decline>", "<i> <pass on>", "no <reply> <may> be <given>", "<acting> would <breach>", "<no topic> that? i <be able>", "<beyond> what i <be able>", "my <norm> ... <bar>", "against <whose> <norm>", "inappropriate for? me? to <act>"],
        "i": ["i"],
        "unable": ["can't", "cant", "cannot", "can not", "couldn't", "could not", "won't", "will not", "wouldn't", "would not", "<am> <not able>", "may not", "must not", "<would> <rather not>", "prefer not"],
        "am": ["am", "-'m"],
        "not able": ["unable", "not able", "not allowed", "not permitted", "not in a position"],
        "would": ["would", "-'d"],
        "rather not": ["rather not", "prefer not"],
        "act": ["answer~", "reply~", "respond~", "help~", "assist~", "discuss~", "say~", "talk~", "speak~", "comment~", "share~", "provide~", "give~", "disclose~", "reveal~", "comply~", "do that", "do this", "do so"],
        "will": ["have to", "have", "need to", "must", "am going to", "would like to", "will", "-'ll must", "-'ll"],
        "decline": ["decline", "refuse", "pass"],
        "pass on": ["-'ll pass", "will pass", "must pass", "have to pass"],
        "reply": ["reply", "answer", "comment", "response", "information"],
        "may": ["can", "may", "will"],
        "given": ["given", "provided", "made"],
        "acting": ["answering", "replying", "responding", "helping", "doing so", "that", "this", "it"],
        "breach": ["go against", "violate", "breach", "be against"],
        "no topic": ["nothing", "not something", "not a topic", "not a subject", "not a question"],
        "be able": ["may", "can", "will", "<am> able to", "<am> allowed to", "am", "-'m"],
        "beyond": ["outside of?", "beyond"],
        "norm": ["instructions", "guidelines", "rules", "policy", "policies", "programming"],
        "bar": ["keep~", "prevent~", "forbid~", "prohibit~", "stop~", "don't", "do not", "won't", "bar~"],
        "whose": ["my", "the", "our"],
    },
    "de": {
        "refusal": ["<modal> ich ... <no>", "ich <modal> ... <no>", "<i am> ... <not able>", "<i speak> ... nichts", "<i speak> ... nicht", "<i must> ... <decline>", "<i decline> ... ab", "<forbid> es? mir"],
        "modal": ["kann", "darf", "möchte", "will", "werde", "könnte", "dürfte"],
        "no": ["nicht", "nichts", "kein~"],
        "i am": ["bin ich", "ich bin"],
        "not able": ["nicht in der lage", "nicht befugt", "nicht berechtigt", "außerstande"],
        "i speak": ["äußere ich mich", "ich äußere mich", "sage ich", "ich sage", "spreche ich", "ich spreche"],
        "i must": ["muss ich", "ich muss"],
        "decline": ["ablehnen", "passen", "verweigern", "absagen"],
        "i decline": ["lehne ich", "ich lehne"],
        "forbid": ["untersagen", "verbieten"],
    },
    "fr": {
        "refusal": ["je <ne> -<modal> ... <act>", "je <prefer> <ne>", "je <must> <decline>", "je refuse", "je décline", "m' -<forbid>", "il <to me> ... <impossible>"],
        "ne": ["ne", "n'"],
        "modal": ["peux", "puis", "souhaite", "veux", "dois", "suis", "saurais", "vais", "pourrai"],
        "act": ["pas", "rien", "évoquer", "répondre", "parler"],
        "prefer": ["préfère", "préférerais", "préférais"],
        "must": ["dois", "me vois obligé de", "me vois obligée de", "me vois contraint de", "me vois contrainte de", "suis obligé de", "suis obligée de", "suis contraint de", "suis contrainte de"],
        "decline": ["refuser", "décliner"],
        "forbid": ["interdisent", "empêchent", "interdit", "empêche"],
        "to me": ["m'est", "ne m'est pas"],
        "impossible": ["impossible", "possible", "permis", "interdit"],
    },
    "es": {
        "refusal": ["no <modal>", "no <be> <able>", "no <me> <allowed>", "<prefer> no", "<must> <decline>", "<they> <bar>"],
        "modal": ["puedo", "voy a", "quiero", "debo", "deseo", "podría", "sabría"],
        "be": ["estoy", "me encuentro"],
        "able": ["en condiciones~", "autorizado~", "autorizada~", "capacitado~", "capacitada~"],
        "me": ["me está", "se me"],
        "allowed": ["permitido~", "permite~"],
        "prefer": ["prefiero", "preferiría"],
        "must": ["debo", "tengo que", "he de"],
        "decline": ["rechazar~", "declinar~", "negarme~"],
        "they": ["me", "me lo"],
        "bar": ["impiden", "prohíben"],
    },
}


def expand(grammar: dict[str, list[str]], production: str, gap: str = "") -> str:
    """The pattern of a production; `gap` stands before its first part, white space between the others."""
    out = ""
    for part in re.findall(r"-?(?:<[^>]+>|\.\.\.|[^\s?]+)\??", production):
        name = part.strip("-?")
        if name == "...":
            out, gap = out + r"\b[^.!?]*?\b", ""
            continue
        here = r"\s*" if gap and part[0] == "-" else gap
        if name[0] == "<":
            pattern = "(?:" + "|".join(expand(grammar, p, here) for p in grammar[name[1:-1]]) + ")"
        else:
            pattern = here + (re.escape(name[:-1]) + r"\w*" if name[-1] == "~" else re.escape(name) + r"\b" * name[-1].isalnum())
        out, gap = out + (f"(?:{pattern})?" if part[-1] == "?" else pattern), r"\s+"
    return out


def first_words(grammar: dict[str, list[str]], production: str) -> set[str]:
    """The words that what a production describes can begin with."""
    part = production.split("> ")[0] if production[0] == "<" else production.split()[0]
    name = part.rstrip("?").strip("<>-")
    if production[0] == "<" or production.startswith("-<"):
        return set().union(*(first_words(grammar, p) for p in grammar[name]))
    return {_WORD.search(name)[0]}


#: A reply without any of them declines nothing.
_FIRST_WORDS = frozenset().union(*(first_words(g, p) for g in GRAMMARS.values() for p in g["refusal"]))
_REFUSAL = re.compile(r"\b(?:" + "|".join(expand(g, p) for g in GRAMMARS.values() for p in g["refusal"]) + ")")
_QUOTES = {'"': re.compile('["\n]'), "“": re.compile("”"), "„": re.compile("[“”]"), "«": re.compile("»")}
_QUOTE = re.compile("[\"“„«]")
# What is long counts as a tag only if it has an attribute with a value.
_TAG = re.compile(r"<[^<>]{0,40}>|<[a-zA-Z][a-zA-Z0-9]{0,15}(?=\s[^<>]*=)(?:\s+[^\s<>=\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>|&\w{1,8};")
_MARKUP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]{0,15})([^<>]*)(>?)")
_ITEM = re.compile(r"([^\S\n]*)(?:[-*•–]|\d+[.)])(?:[^\S\n]+\[[ xX]\])?(?=\s|$)")
_OPEN, _CLOSE = "([{«„“", ")]}»””"
#: What can open anything: without it there is nothing to parse.
_OPENS, _MARKS = ('"', "<", "(", "[", "{", "«", "„", "“", "```"), frozenset("-*•–0123456789 \t\xa0")
_LISTED = re.compile(r"^[^\S\n]*(?:[-*•–]|\d+[.)])(?=\s|$)", re.MULTILINE)


def is_empty(text: str | None) -> bool:
    """Says nothing: null, no letter or digit, or only a placeholder."""
    if text is None:
        return True
    bare = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    if not any(c.isalnum() for c in bare):
        return True
    return len(bare) < 64 and bare.lower().strip(" \t\r\n\xa0​[](){}<>\"'*_.:-“”«»") in PLACEHOLDERS


def unquoted(text: str) -> str:
    """The text with a space for each quotation, however long; plain quotation marks don't reach beyond a line."""
    out, k, unpaired = [], 0, set()
    while m := _QUOTE.search(text, k):
        end = None if m[0] in unpaired else _QUOTES[m[0]].search(text, m.end())
        if end and end[0] != "\n":
            out += text[k : m.start()], " "
            k = end.end()
        else:
            if not end:
                unpaired.add(m[0])
            out.append(text[k : m.end()])
            k = m.end()
    return "".join(out) + text[k:]


def open_structures(text: str) -> list[str]:
    """Parses fences, brackets, quotation marks, lists and markup with a stack; what is on it at the end was never closed.

    A list has a level for each indent, and its item is open until something stands in it; the next item of its level or
    of one further out ends it.
    A closing mark without its partner is passed over, as in numbered lists or smileys. A plain quotation mark opens after white
    space or an opening bracket and closes otherwise, so that inch marks don't count.
    """
    if not any(c in text for c in _OPENS) and not (("\n" in text or text[:1] in _MARKS) and _LISTED.search(text)):
        return []
    stack: list[str] = []
    items: list[list] = []
    k, n = 0, len(text)
    while k < n:
        if (k == 0 or text[k - 1] == "\n") and "```" not in stack and (m := _ITEM.match(text, k)):
            while items and items[-1][0] >= len(m[1]):
                items.pop()
            items.append([len(m[1]), True])
            k = m.end()
            continue
        c = text[k]
        if items and items[-1][1] and not c.isspace():
            for item in items:
                item[1] = False
        if text.startswith("```", k):
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
            k += 3
            continue
        if "```" in stack:
            k += 1
            continue
        if c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            elif k == 0 or text[k - 1].isspace() or text[k - 1] in "([{-–—":
                stack.append('"')
        elif c in _CLOSE and stack and any(_CLOSE[_OPEN.index(o)] == c or (o == "„" and c == "“") for o in stack if o in _OPEN):
            while stack:
                o = stack.pop()
                if o in _OPEN and _CLOSE[_OPEN.index(o)] == c:
                    break
        elif c == "“" and "„" in stack:
            del stack[stack.index("„") :]
        elif c in _OPEN:
            stack.append(c)
        elif c == "<" and (m := _MARKUP.match(text, k)):
            closing, name, attributes, end = m.groups()
            if not end:
                stack.append("<")
            elif closing:
                if name in stack:
                    del stack[stack.index(name) :]
            elif not attributes.endswith("/") and name.lower() not in ("br", "hr", "img", "p", "li", "input", "meta"):
                stack.append(name)
            k = m.end()
            continue
        k += 1
    return stack + ["-"] if items and items[-1][1] else stack


def _grams(rolled: list[int], power: int, free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Where a stretch of `length` free words begins, and its hash."""
    run = 0
    for end, ok in enumerate(free, 1):
        run = run + 1 if ok else 0
        if run >= length:
            yield end - length, (rolled[end] - rolled[end - length] * power) % _MODULUS


def tiles(a: list[str], b: list[str], shortest: int = MIN_TILE) -> int:
    """Greedy string tiling: how many words of `a` can be covered by stretches shared with `b`, longest first, each word used once.

    Stretches are found by rolling hashes (Karp-Rabin). The greatest length that free words still share is found by
    bisection, and all tiles of it are laid at once: a pass is linear, and n words have at most sqrt(2n) lengths of tiles.
    """
    codes: dict[str, int] = {}
    rolled = []
    for words in (a, b):
        sums = [0]
        for w in words:
            sums.append((sums[-1] * _BASE + codes.setdefault(w, len(codes) + 1)) % _MODULUS)
        rolled.append(sums)
    free_a, free_b, covered, longest = [True] * len(a), [True] * len(b), 0, min(len(a), len(b))

    def shared(length: int) -> bool:
        power = pow(_BASE, length, _MODULUS)
        theirs = {h for _, h in _grams(rolled[1], power, free_b, length)}
        return any(h in theirs for _, h in _grams(rolled[0], power, free_a, length))

    while longest >= shortest:
        low = shortest - 1
        while low < longest:
            middle = (low + longest + 1) // 2
            low, longest = (middle, longest) if shared(middle) else (low, middle - 1)
        if longest < shortest:
            break
        power = pow(_BASE, longest, _MODULUS)
        where: dict[int, deque[int]] = {}
        for j, h in _grams(rolled[1], power, free_b, longest):
            where.setdefault(h, deque()).append(j)
        for i, h in list(_grams(rolled[0], power, free_a, longest)):
            places = where.get(h)
            # No later tile of this length is within another, so that a used one has a used end.
            if not places or not (free_a[i] and free_a[i + longest - 1]):
                continue
            while places:
                j = places.popleft()
                if free_b[j] and free_b[j + longest - 1]:
                    free_a[i : i + longest] = free_b[j : j + longest] = [False] * longest
                    covered += longest
                    break
        longest -= 1
    return covered


def is_echo(question: list[str], reply: list[str]) -> bool:
    """Whether a reply holds nearly all of the question and nearly nothing else, possibly several times over."""
    if len(question) < 2 or not ECHO_SHARE * len(question) <= len(reply) <= 12 * len(question):
        return False
    times = max(1, round(len(reply) / len(question)))
    own, asked = Counter(reply), Counter(question)
    shared = sum(min(n, times * asked[w]) for w, n in own.items())
    if shared < ECHO_SHARE * len(reply):
        return False
    if reply == question * times:
        return True
    return tiles(reply, question * times) >= ECHO_SHARE * len(reply) and tiles(question, reply) >= ECHO_SHARE * len(question)


def question_language(words: list[str]) -> str | None:
    """The language whose function words are the most, if one has more than all others."""
    counts = sorted(((sum(w in known for w in words), language) for language, known in _FUNCTION_SETS.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else None


_FUNCTION_SETS = {k: set(v) for k, v in FUNCTION_WORDS.items()}
LANGUAGES = tuple(FUNCTION_WORDS)


class _Marked(dict):
    """Words as they tell a language: capitalised ones marked, as they may be names, nothing for one with a digit; remembered, up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = marked = "" if any(map(str.isdigit, word)) else f"^{word.lower()}" if word[0].isupper() else word
        return marked


_marked = _Marked()


def _reply_words(text: str) -> list[str]:
    """Words that tell a language: without quotations and numbers."""
    return [w for w in map(_marked.__getitem__, _WORD.findall(unquoted(text))) if w]


_FAR, _LETTER = re.compile("[\u0250-\U0010ffff]"), re.compile(r"[^\W\d_]")


def script(text: str) -> str | None:
    """The script of most letters: latin, cyrillic, greek, arabic, hebrew, han or kana, hangul, or None without letters."""
    if not _FAR.search(text):
        return "latin" if _LETTER.search(text) else None
    counts: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            o = ord(c)
            counts["latin" if o < 0x250 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "hebrew" if 0x590 <= o < 0x600 else "arabic" if 0x600 <= o < 0x780 else "hangul" if 0xAC00 <= o < 0xD7B0 else "cjk" if 0x2E80 <= o < 0xAC00 else "other"] += n
    return counts.most_common(1)[0][0] if counts else None


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter[str]] = {}
        for question, texts in zip(batch["question"], batch["texts"], strict=True):
            if language := question_language(_WORD.findall((question or "").lower())):
                for text in texts:
                    if text:
                        counts.setdefault(language, Counter()).update(set(_reply_words(text)))
        yield pd.DataFrame([(w, language, n) for language, words in counts.items() for w, n in words.items()], columns=["word", "language", "n"])


class LanguageModel:
    """How much each word speaks for each language, from how many replies to questions in that language have it."""

    def __init__(self, rows: list[tuple[str, str, int]], totals: dict[str, int]):
        by_word: dict[str, dict[str, int]] = {}
        for word, language, n in rows:
            by_word.setdefault(word, {})[language] = n
        self.weights = {w: {k: math.log((counts.get(k, 0) + 0.5) / (totals.get(k, 0) + 100)) for k in LANGUAGES} for w, counts in by_word.items()}

    def margin(self, words: list[str], own: str) -> float:
        """How much likelier the words are in the best other language than in `own`."""
        sums = dict.fromkeys(LANGUAGES, 0.0)
        for w in set(words):
            for k, x in self.weights.get(w, {}).items():
                sums[k] += x
        return max(v for k, v in sums.items() if k != own) - sums[own]


class Question:
    """What of a question its replies are held against."""

    def __init__(self, text: str | None):
        text = text or ""
        words = _WORD.findall(text.lower())
        self.script, self.language, self.words = script(text), question_language(words), set(words)
        self.asked = words[1:] if len(words) > 1 and words[0] in ("q", "question", "frage", "pregunta") else words


def _language_differs(model: LanguageModel, question: Question, text: str) -> bool:
    own = question.language
    if question.script and (t := script(text)) and question.script != t:
        return True
    return own is not None and model.margin([w for w in _reply_words(text) if w.lstrip("^") not in question.words], own) > LANGUAGE_MARGIN


_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\s\")\]”»]*$")
_STOP = re.compile(r"[.!?][\"'”’»)\]*_]*$")


def stops_short(text: str, siblings: list[str]) -> bool | None:
    """Whether the form of a reply shows that it breaks off; None if only the corpus can tell.

    `siblings` are the other texts of the same question: a last word that one of them has longer, after the same word,
    was cut.
    """
    text = _TAG.sub(" ", text).rstrip("​ \t\r\n\xa0")
    if _ELLIPSIS.search(text[-16:]) or "�" in text[-2:]:
        return True
    if open_structures(text):
        return True
    if _STOP.search(text[-16:]):
        return None if re.search(r"[^\W\d_]\.[\"'”’»)\]*_]*$", text[-16:]) else False
    if not text[-1:].isalnum():
        return text[-1:] not in "\"'”’»)]}*_%°€$£`"
    words = _WORD.findall(text.lower()) if siblings else []
    if len(words) > 1:
        for other in siblings:
            theirs = _WORD.findall(other.lower())
            for a, b in zip(theirs, theirs[1:], strict=False):
                if a == words[-2] and b != words[-1] and b.startswith(words[-1]) and words[-1] not in theirs:
                    return True
    return None


def verdict(model: LanguageModel, question: Question, text: str | None, siblings: list[str]) -> str | None:
    """The defect of a reply, None for none, 'ask' if only the corpus can tell."""
    if is_empty(text):
        return "empty"
    words = _WORD.findall(text.lower())
    if not _FIRST_WORDS.isdisjoint(words) and _REFUSAL.search(unquoted(text).replace("’", "'").lower()):
        return "refusal"
    if is_echo(question.asked, words):
        return "echo"
    if _language_differs(model, question, text):
        return "language"
    short = stops_short(text, siblings)
    return "ask" if short is None else "truncated" if short else None


def _judge(model: LanguageModel):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for qid, asked, excused, texts in zip(batch["qid"], batch["question"], batch["excused"], batch["texts"], strict=True):
                question = Question(asked)
                for part, text in enumerate(texts):
                    if part or text is not None or not excused:
                        found = verdict(model, question, text, [s for s in texts if s and s != text])
                        if found:
                            out.append((qid, part, found, text if found == "ask" else None))
            yield pd.DataFrame(out, columns=["qid", "part", "verdict", "text"])

    return judge


def find_defective_pairs(questions: DataFrame) -> DataFrame:
    """The questions with a defective reply: `question_id`, `part` (0 for the answer, from 1 for the claims) and `defect`.

    `questions` has question_id, text, no_answer and response (struct of answer and claims, an array of structs with
    text). A missing answer is a defect unless `no_answer` is true; null flags count as false, a null list of claims
    as none. Rows repeated in full count once. A null question echoes nothing and has no language.
    """
    rows = questions.select("question_id", F.col("text").alias("question"), F.coalesce("no_answer", F.lit(False)).alias("excused"), F.col("response.answer").alias("answer"), F.expr("transform(response.claims, c -> c.text)").alias("claims")).distinct()
    texts = F.concat(F.array("answer"), F.coalesce("claims", F.array().cast("array<string>")))
    rows = cut_lineage(rows.select(F.monotonically_increasing_id().alias("qid"), "question_id", "question", "excused", texts.alias("texts")))

    replies = rows.select(F.explode("texts").alias("text")).where("text is not null")
    total = replies.count()
    counted = cut_lineage(rows.select("question", "texts").mapInPandas(_count_words, "word string, language string, n long").groupBy("word", "language").agg(F.sum("n").alias("n")))
    # At most WORD_SHARE words times the words of a reply pass this: a bounded table, however large the corpus.
    frequent = counted.join(counted.groupBy("word").agg(F.sum("n").alias("all")), "word").where(F.col("all") >= F.when(F.col("word").startswith("^"), max(MIN_REPLIES_CAPITAL, total // WORD_SHARE)).otherwise(max(MIN_REPLIES, total // WORD_SHARE))).collect()
    totals = {r.language: r.n for r in counted.groupBy("language").agg(F.max("n").alias("n")).collect()}
    model = LanguageModel([(r.word, r.language, r.n) for r in frequent], totals)

    verdicts = cut_lineage(rows.select("qid", "question", "excused", "texts").mapInPandas(_judge(model), "qid long, part int, verdict string, text string").withColumn("id", F.monotonically_increasing_id()))
    evidence = ending_evidence(replies, verdicts.where("verdict = 'ask'").select("id", "text"), copies_count=True)
    stopped = F.col("dot_rate").isNotNull()
    told = evidence.where((~stopped & (F.col("longer").isNotNull() | (F.col("end_rate") < LOW_END_RATE))) | (F.col("dot_rate") < LOW_DOT_RATE)).select("id", F.lit("truncated").alias("told"))
    found = verdicts.drop("text").join(told, "id", "left").withColumn("defect", F.coalesce("told", F.when(F.col("verdict") != "ask", F.col("verdict")))).where("defect is not null")
    return rows.select("qid", "question_id").join(found, "qid").select("question_id", "part", "defect")


def one_defect(found: DataFrame) -> DataFrame:
    """One row a question: its defect, and of several the first in the order of DEFECTS."""
    order = F.array_position(F.array(*(F.lit(d) for d in DEFECTS)), F.col("defect"))
    return found.groupBy("question_id").agg(F.min(order).alias("d")).select("question_id", F.element_at(F.array(*(F.lit(d) for d in DEFECTS)), F.col("d").cast("int")).alias("defect"))
