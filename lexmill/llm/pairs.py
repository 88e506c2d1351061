"""Broken prompt and response pairs.

A response is compressed with its prompt, and wordings that frame one, as a zstandard dictionary: what
the compressor still has to write is what the response adds, and a copy adds next to nothing. Languages and refusals are told by
dictionaries. Whether the end of a response can be an end is asked of a terminal-context model: how
often its last words, counted over all responses, close a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.stage import stage
from lexmill.sources.tables import live_rows

# Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of to and a in is it by for that must be shall may with not or as within every has have which how what when who does under each any no from on this should was are an before cannot than only ought",
    "de": "der die das den dem des ein eine einen und ist nicht bis zum zur muss soll darf wird mit bei nach von vor auf im wie wer wann welche innerhalb danach oft einmal jeder kann ich leider diese nicht für sich werden",
    "fr": "le la les des du un une et est ne pas à dans chaque doit peut devrait puis avant après selon sans je qui quelle que pour au aux en tenu délai sur il ce cette suis être par de",
    "es": "el la los las un una y es no que del al en con cada debe puede debería tiene luego antes después según sin qué quién cuándo para por se plazo lo me esta este siento de frecuencia",
    "ms": "yang dan di ke itu ini untuk dengan perlu boleh hendaklah mesti setiap selepas sebelum dalam tempoh kemudian menurut tidak saya siapa bila apakah berapa kerapkah pihak hari oleh maaf dapat adalah tanpa telah akan atau juga kepada antara bagi mereka kami kita semua seperti",
}
# What stands for an answer where there is none.
PLACEHOLDERS = """
n/a na n.a. null nil nan none tbc tbd tba todo undefined empty blank pending missing unknown void xxx
none given|no answer|not given|not provided|no answer given|no answer provided|to be confirmed|to be completed|no response|no text|answer|response|reply|a|antwort|réponse|respuesta|jawapan|keine angabe|sin respuesta|aucune réponse|tiada jawapan
"""
# Wordings that decline to answer.
REFUSALS = r"""
\b(?:can(?:not|'t| not)|could not|couldn't|won't|will not|unable to|not able to|am not (?:able|permitted|allowed)|not in a position to)\b[^.;]{0,40}\b(?:help|assist|answer|respond|comment|determine|say|tell|provide|give|discuss|find|advise|confirm|locate|identify)\b
\bwon't be able to\b
\bnot able to (?:assist|help|answer)
\bunable to (?:assist|help|answer|give|provide|comment|determine|respond|say)
\b(?:do not|don't|did not|didn't) have (?:enough|sufficient|any|the) (?:information|context|evidence|material)
\bnot (?:be )?appropriate for me\b
\boutside (?:what|the scope|my)\b[^.;]{0,60}\b(?:permitted|allowed|discuss|scope|remit|able)\b
\b(?:instructions|guidelines|policy|rules) (?:prevent|forbid|do not allow|don't allow|prohibit) me\b
\bdecline to\b|\bi (?:must|have to|would) decline\b|\bi refuse\b
\bas an (?:ai|assistant|language model)\b
\b(?:material|excerpts?|documents?|text|sources?|context|passages?|information|clauses?) (?:provided |given |supplied |cited |available )?(?:do|does|did) not (?:address|contain|mention|cover|say|answer|state|specify|deal with)\b
\bcannot be (?:answered|determined|established|said)\b
\bno (?:provision|clause|information|passage|evidence|rule|answer)\b[^.;]{0,60}\b(?:turned up|found|available|exists|given)\b
\bleave the question open\b
\bsomething i (?:can't|cannot|am unable)\b
\bcould not find\b
\bje ne (?:peux|suis|saurais|dispose)\b|\bdésolée?\b|\bje (?:refuse|regrette)\b|\bimpossible de répondre\b
\bno (?:puedo|me es posible|estoy en|dispongo|es posible)\b|\blo siento\b|\blamento\b
\b(?:kann|darf|möchte) ich (?:leider |hier |dazu |diese frage )*(?:nicht|keine?)\b|\bich kann (?:das|diese|ihnen|dazu|hier|leider)[^.;]{0,40}\b(?:nicht|keine?)\b|\btut mir leid\b|\bes ist mir nicht möglich\b|\bkann ich leider\b
\bsaya tidak (?:dapat|boleh|mampu)\b|\bmaaf\b|\btidak dapat (?:menjawab|membantu)\b
"""
#: Wordings by which an answer that repeats its question frames it; with the question they are the dictionary.
FRAMING = """
the question is question q the prompt is prompt you ask you asked you are asking you were asking you want to know you wanted to know you would like to know
thank you for your question thank you for your query thanks for asking regarding about as to concerning in response to in answer to your question your request your enquiry was
the answer is the answer to the question answer a response reply restated again here is to repeat i was asked i am asked asked whether re for they said says
die frage lautet frage antwort sie fragen sie möchten wissen ihre frage danke für
la question est question réponse vous demandez vous voulez savoir votre question merci pour
la pregunta es pregunta respuesta usted pregunta quiere saber su pregunta gracias por
soalan soalannya ialah jawapan anda bertanya anda ingin tahu terima kasih atas soalan anda
"""
#: Bytes that a copy may add beyond its question, as zstandard writes them.
COPY_BYTES = 10
# What opens a clause that needs another one, and verbs that make one.
OPENERS = re.compile(r"^(?:where|if|unless|provided|save that|in setting|for the purposes? of|having regard|when|while|although|because|in addition|notwithstanding)\b")
VERBS = re.compile(r"\b(?:shall|must|may|should|ought|is|are|was|were|has|have|had|will|would|can|cannot|could|does|do|did|stood|falls|prevents?|includes?|means|contains?|applies|appl[yi]|requires?|needs?)\b")

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d[\d.,]*\d|\d")
_TOKEN = re.compile(r"([^\W\d_]+(?:['’\-][^\W\d_]+)*|\d[\d.,]*\d|\d)|([.?!;:]+(?=[\s\"'”)\]*]|$)|\n)|([(\[])")
_NOTHING = "​‌‍⁠﻿­"
_CUT_MARK = re.compile(r"[\s(\[<]*(?:\[(?:cut|truncated|\.\.\.|…)\]|\((?:cut|truncated|continued)\)|<(?:cut|truncated)>|…|\.\.\.)\s*$", re.I)
_CLOSERS = " \t\r\n*_`\"'”’»"


@lru_cache(1)
def _languages() -> dict[str, list[tuple[str, float]]]:
    """The languages of each function word; one of several languages counts for each by its part."""
    owners: dict[str, list[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in set(words.split()):
            owners.setdefault(w, []).append(lang)
    return {w: [(lang, 1 / len(langs)) for lang in langs] for w, langs in owners.items()}


@lru_cache(1)
def _refusals() -> re.Pattern:
    return re.compile("|".join(f"(?:{line})" for line in REFUSALS.strip().splitlines()), re.I)


@lru_cache(1)
def _placeholders() -> set[str]:
    first, rest = PLACEHOLDERS.strip().split("\n")
    return {re.sub(r"[^\w]+", " ", x).strip() for x in [*first.split(), *rest.split("|")]} - {"none", "unknown"}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def says_nothing(answer: str | None) -> bool:
    """Null, blank, only signs, or a placeholder."""
    if answer is None:
        return True
    if len(answer) > 64 and len("".join(re.findall(r"\w+", answer[:400]))) > 64:
        return False  # more to read already than any placeholder has
    plain = " ".join(re.findall(r"\w+", answer.lower().translate(dict.fromkeys(map(ord, _NOTHING))).replace("_", " ")))
    return not plain or plain in _placeholders()


def language(text: str) -> tuple[str | None, dict[str, float]]:
    """The language with most function words and the scores; None below two words, or below one where
    no other language has any."""
    scores = dict.fromkeys(FUNCTION_WORDS, 0.0)
    known = _languages()
    for w in words_of(text):
        for lang, weight in known.get(w, ()):
            scores[lang] += weight
    best = max(scores, key=scores.get)
    alone = scores[best] >= 1 and sum(scores.values()) == scores[best]
    return (best if scores[best] >= 2 or alone else None), scores


@lru_cache(1)
def _framing() -> tuple[bytes, set[str]]:
    words = re.findall(r"\w+", FRAMING)
    return " ".join(words).encode() + b" ", set(words)


def added_bytes(question: list[str], answer: list[str]) -> int:
    """Bytes that zstandard needs for the answer's words with framings and the question's as its
    dictionary, less what it needs for the question itself."""
    import zstandard

    q, a = " ".join(question).encode(), " ".join(answer).encode()
    known = zstandard.ZstdCompressionDict(_framing()[0] + q + b" " + q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=known)
    return len(compressor.compress(a)) - len(compressor.compress(q))


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer only repeats the question, whatever its framing.

    The compressor decides; what it lets through is checked exactly: most of the question's words must
    be there, and beside them only framing and misspelt ones, so that "yes" or a name is an answer."""
    if not question or not 0.6 * len(question) <= len(answer) <= 2 * len(question) + 400:
        return False
    q, a = re.findall(r"\w+", question.lower()), re.findall(r"\w+", answer.lower())
    if not q or added_bytes(q, a) > COPY_BYTES:
        return False
    left, spare = Counter(q), []
    for w in a:
        if left[w] > 0:
            left[w] -= 1
        else:
            spare.append(w)
    missing = [w for w, n in left.items() if n > 0]
    if sum(left[w] for w in missing) > max(1, 0.15 * len(q)):
        return False
    return all(w in _framing()[1] or w in q or any(_misspelt(w, m) for m in missing) for w in spare)


def _misspelt(a: str, b: str) -> bool:
    """Whether two words differ by a swap of neighbours, or by one letter more, less or other."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] in (b[k + 1 :], b[k:]) or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def declines(answer: str) -> bool:
    """Whether the answer declines and says nothing else that fits."""
    if not _refusals().search(answer.replace("’", "'")):
        return False
    said = False
    for sentence in re.split(r"(?<=[.?!])\s+|\n+", answer.replace("’", "'").strip()):
        m = _refusals().search(sentence)
        if m:
            if re.search(r",? (?:but|however|yet|nevertheless|although)\b(?! i\b| we\b)", sentence[m.end() :]) and VERBS.search(sentence[m.end() :].lower()):
                return False
            said = True
        elif VERBS.search(sentence.lower()) and not re.match(r"(?i)i (?:have |had )?(?:looked|searched|checked|read|reviewed)\b|sorry|unfortunately|please|neither\b|you (?:may|could|should)|for that", sentence):
            return False
        elif not sentence.isascii() and len(words_of(sentence)) > 5:
            return False
    return said


def wrong_language(question: str | None, answer: str) -> bool:
    if not question:
        return False
    asked, _ = language(question)
    spoken, scores = language(answer)
    if asked is None or spoken is None or asked == spoken:
        return False
    return scores[spoken] > 1.5 * scores[asked] and (scores[spoken] >= 2 or len(words_of(answer)) >= 5)


def _key(word: str) -> str:
    return "#" if word[0].isdigit() else word.lower()


def ending(answer: str) -> tuple[str, str, str]:
    """(verdict, word before the last, last word): cut, whole, or, for the model to say, ask or list."""
    text = answer.strip().translate(dict.fromkeys(map(ord, _NOTHING)))
    if _CUT_MARK.search(text):
        return "cut", "", ""
    bare = text.rstrip(_CLOSERS)
    if not bare:
        return "whole", "", ""
    # The fragment: what follows the last sentence that is closed.
    closed = [m.end() for m in re.finditer(r"[.?!][\"'”’)\]]*(?=\s)|\n", bare)]
    piece = bare[closed[-1] :].strip() if closed else bare
    opened = max(piece.rfind("("), piece.rfind("["))
    closing = max(piece.rfind(")"), piece.rfind("]"))
    if opened > closing:
        return "cut", "", ""
    last = bare[-1]
    if last in ".?!":
        return ("cut" if text.count('"') % 2 and not text.endswith('"') and bare.count('"') % 2 else "whole"), "", ""
    if last in ",;:-–—/&(":
        return "cut", "", ""
    if text.count('"') % 2:
        return "cut", "", ""
    if last in ")]}>%":
        return "whole", "", ""
    words = words_of(piece)
    if not words:
        return "whole", "", ""
    clause = piece.lower().lstrip("-*• ")
    clause = re.sub(r"^\(?[a-z0-9]{1,3}[).]\s+", "", clause)
    if OPENERS.match(clause) and not re.search(r",.*?" + VERBS.pattern, clause):
        return "cut", "", ""
    listed = bool(re.search(r"(?:^|\n)\s*(?:[-*•]|\(?[a-z0-9]{1,3}[).])\s", "\n" + piece if not closed else bare[closed[-1] - 1 :]))
    if re.match(r"\(?[a-z0-9]{1,3}[).]\s", piece) and re.search(r";\s*$", bare[: closed[-1]] if closed else ""):
        return "cut", "", ""  # its list closes each item with a sign and this one not
    if closed and not listed and not VERBS.search(clause) and piece.isascii():
        return "cut", "", ""
    if not closed and len(words) <= 4 and not VERBS.search(clause) and words[-1] not in FUNCTION_WORDS["en"].split()[:16]:
        return "whole", "", ""  # a short answer such as a name, a date or an amount
    return "list" if listed else "ask", _key(words[-2]) if len(words) > 1 else "^", _key(words[-1])


def terminal_counts(texts: list[str | None]) -> dict[tuple[str, str], list[int]]:
    """(word before, word) -> [ends, occurrences] over tokens that something follows."""
    seen: dict[tuple[str, str], list[int]] = {}
    for text, times in Counter(t for t in texts if t).items():
        before, word = "^", None
        for w, end, _ in _TOKEN.findall(text.lower()):
            if word is not None:
                c = seen.get((before, word))
                if c is None:
                    c = seen[before, word] = [0, 0]
                c[1] += times
                if end:
                    c[0] += times
            if w:
                before, word = (word or "^"), ("#" if w[0].isdigit() else w)
            elif end:
                before, word = "^", None
            else:
                before, word = (word or "^"), None
    return seen


def defective_pairs(rows: DataFrame, share: float = 0.08) -> DataFrame:
    """(arm, task_id, defect) of the live pairs that have a defect, one each.

    ``rows``: arm, task_id, question, answer, gold_answer, must_abstain, made_at. Of several defects the first of
    empty, copy, refusal, wrong_language, truncated counts. ``share`` is the share of occurrences
    that must close a sentence for the last words to be an end. Null keys give no row; a null
    question leaves only empty, refusal and truncated; a null must_abstain counts as false."""
    live = live_rows(rows, ["arm", "task_id"], "made_at", ["question", "answer", F.coalesce("must_abstain", F.lit(False)).alias("abstain"), "gold_answer"])
    live = stage(live, "pairs-live")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, a, abstain in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if says_nothing(a):
                    out.append(("empty", None, None, None))
                elif is_copy(q, a):
                    out.append(("copy", None, None, None))
                elif declines(a):
                    out.append((None if abstain else "refusal", None, None, None))
                elif wrong_language(q, a):
                    out.append(("wrong_language", None, None, None))
                else:
                    verdict, before, word = ending(a)
                    asks = verdict in ("ask", "list")
                    out.append(("truncated" if verdict == "cut" else None, before if asks else None, word if asks else None, verdict == "list"))
            columns = list(zip(*out)) if out else [()] * 4
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["arm", "task_id", "defect", "before", "word", "listed"])

    kinds = {f.name: f.dataType.simpleString() for f in live.schema}
    judged = stage(live.mapInArrow(judge, f"arm {kinds['arm']}, task_id {kinds['task_id']}, defect string, before string, word string, listed boolean"), "pairs-judged")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = terminal_counts([*batch.column(0).to_pylist(), *(f"{t}." if t else t for t in batch.column(1).to_pylist())])
            keys, values = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["before", "word", "ends", "n"])

    asked = judged.where("word IS NOT NULL")
    counted = live.select("answer", "gold_answer").mapInArrow(count, "before string, word string, ends long, n long")
    # Only words that some response ends with are counted further.
    counted = counted.join(asked.select("word").distinct(), "word", "left_semi").groupBy("before", "word").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    counted = stage(counted, "pairs-ends")
    single = counted.groupBy("word").agg(F.sum("ends").alias("w_ends"), F.sum("n").alias("w_n"))
    # The word pair where it is known well, else the word; a word never seen whole is a piece of one.
    ask = asked.join(counted, ["before", "word"], "left").join(single, "word", "left")
    chance = F.when(F.coalesce("n", F.lit(0)) >= 8, F.col("ends") / F.col("n")).otherwise(F.coalesce(F.try_divide("w_ends", "w_n"), F.lit(0.0)))
    # List items are noun phrases, whose last words close few sentences.
    cut = ask.where(chance < F.when(F.col("listed"), share / 10).otherwise(share)).select("arm", "task_id", F.lit("truncated").alias("defect"))
    return judged.where("defect IS NOT NULL").select("arm", "task_id", "defect").unionByName(cut)
