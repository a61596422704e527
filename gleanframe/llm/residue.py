"""Template residue and error-page text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.session import cut

#: Words below the word count by which the prefix tree routes a message, and the share of
#: its words that a template keeps as messages merge into it.
DEPTH, KEPT_SHARE = 3, 0.7
#: Where a message gives itself away in so many words, it is flagged as a whole.
HEAD = 12
#: Parts of a verdict's rows, for the join with the messages.
SALTS = 8
#: Bits of the filter of leaves for each of them, and the largest filter in bits. A fuller
#: filter lets more lines through, and loses none.
BITS_PER_LEAF, MAX_FILTER_BITS = 16, 1 << 28
#: Texts whose lines a worker holds at a time.
TEXTS_AT_ONCE = 128
#: So many characters of other text may stand beside a message that takes the
#: place of a record's content (navigation, a footer, a request number).
SIDE_TEXT = 160
#: A line of at least so many words, of which at least this share is filler Latin or keyboard filling.
LATIN_WORDS, LATIN_SHARE = 8, 0.6

_LINES = re.compile(r"[\r\n]+")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^\W\d_]+")
#: A line that begins or ends fenced code; code in one line does neither.
_FENCE = re.compile(r"\s*(?:```[^`]*$|~~~)")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\s+[|»›·•–—]\s+")

# The words of the customary filler Latin.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt
    ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea
    commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
    occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus pellentesque
    mattis ornare sodales quisque porta gravida blandit cursus dictum feugiat nonummy erat lacinia vestibulum rutrum
    massa nibh euismod tincidunt laoreet volutpat wisi vel augue praesent lectus mauris nunc viverra integer
    donec proin morbi curabitur aenean fusce phasellus suspendisse maecenas nullam etiam cras sem justo tellus urna
    eget ac at eu nec turpis arcu ante leo odio orci pede purus risus sapien vitae""".split()
)

# What hands type to fill a box.
_MASH = frozenset("qwerty qwertz azerty asdf asdfgh asdfasdf sdfg hjkl zxcv zxcvbn foo bar baz qux foobar blah bla test testing xxx yyy zzz abc aaa dummy".split())

_I = re.IGNORECASE
_SCRIPT = r"(?:java\s?script|scripts?\b|scripting|cookies?\b|скрипт\w*|куки|脚本|スクリプト|クッキー)"
#: Message kinds and what their templates say. A template is a message with its
#: numbers replaced by ``<*>``.
_MESSAGES = {
    "notice": [
        rf"^(?:\W*<noscript>)?.{{0,40}}\b(?:enable|activate|turn on|switch on|allow|accept|activer|activez|aktivieren|activar|active|habilite)\b.{{0,30}}{_SCRIPT}",
        rf"{_SCRIPT}\W.{{0,40}}\b(?:enabled|nécessaire|erforderlich|aktivieren|einschalten|necesario|requis|must be)\b",
        rf"{_SCRIPT}\W.{{0,40}}\b(?:required|needed|disabled|switched off|turned off|is off)\b(?!\s+by\s+(?:the|a|an)\b)(?!\s+for\s+(?!(?:this|the|our|some|full|all|parts?)\b))",
        rf"\b(?:requires?|needs?|without|please turn on|nécessite|benötigt|requiere)\b.{{0,20}}{_SCRIPT}",
        r"(?:включите|активируйте|требуется|необходим).{0,30}(?:javascript|cookie|скрипт)|(?:启用|开启|打开|需要|啟用).{0,10}(?:javascript|cookie|脚本)|(?:javascript|cookie|スクリプト).{0,12}(?:有効|必要|オン)",
        r"\bjs is (?:disabled|off|switched off|turned off|required|not enabled)\b",
        r"\b(?:checking|verifying) (?:that |if )?(?:your browser|(?:the|this) (?:site|page) connection|you are (?:not a robot|human))|\bbrowser check\b",
        r"^just a moment\W*$|^attention required\b|\b(?:complete|solve) (?:the|this) (?:captcha|security check)\b|\b(?:verify|confirm|prove) (?:that )?you(?:'re|’re| are) (?:a |not a )?(?:human|robot|bot)\b|\bddos protection by\b",
        r"\byour browser (?:is (?:not supported|out of date|too old)|does(?:n't|n’t| not) support)\b|^(?:you are using an )?(?:unsupported|outdated) browser\b",
    ],
    "error": [
        r"^(?:http/\S+ )?(?:error )?(?:<\*> )?(?:not found|internal server error|service unavailable|bad gateway|gateway time-?out|forbidden|gone|too many requests|unauthorized|bad request|method not allowed|request time-?out|not implemented|moved permanently)\W*$",
        r"<title>\W*(?:error )?<\*>|<h<\*>>\s*(?:error|not found|internal server error|forbidden|gone|bad gateway|service unavailable|gateway timeout|too many requests)",
        r'^\{\s*"(?:status|code|error|message)"\s*:.{0,80}"(?:error|message|status|detail)"\s*:',
        r"^(?:error|erreur|fehler|ошибка|错误|エラー|錯誤|오류)\s*:?\s*<\*>\W*(?:$|.{0,80}(?:page|seite|página|страниц|页面|ページ|introuvable|nicht gefunden|не найден|no se encontr|找不到|見つかりません))",
        r"\b(?:page|file|resource|url|document|snippet) (?:you (?:asked for|requested|are looking for)|was (?:deleted|removed)|requested)\b.{0,60}|\b(?:page|file) (?:does not exist|could not be found|not found)\b|\bwas deleted by its owner\b",
        r"^(?:(?:whoops|oops|uh[- ]?oh|sorry)\W+)?(?:(?:it )?looks like )?(?:something (?:broke|went wrong)|an? (?:unexpected |internal |unknown )?error (?:has )?occurred)\b",
        r"^(?:(?:whoops|oops|uh[- ]?oh|sorry)\W+)(?:(?:but )?(?:we|i) (?:can(?:'t|’t|not)|could(?:n't|n’t| not)) (?:find|load|reach|open|show)|(?:that|this|the) (?:page|link|url|file)\b)",
        r"^error establishing an? (?:database|server) connection\b|^this (?:site|page|webpage) can(?:'t|’t|not) be (?:reached|found|displayed)\b|^(?:this|your) (?:account|site|website) (?:has been|is) (?:suspended|disabled)\b|^(?:bandwidth|quota) (?:limit )?exceeded\b|^(?:this )?domain (?:name )?(?:is|may be) for sale\b",
        r"\bpagina non trovata\b|\bpágina no encontrada\b|\bpágina não encontrada\b|\bpagina niet gevonden\b|\bsidan hittades inte\b|\bnie znaleziono strony\b|페이지를 찾을 수 없|页面不存在|無法找到",
        r"\bthe upstream (?:took too long|gave an invalid answer|server)\b|^(?:oops\W+|sorry\W+)?we are down for maintenance|\brate limit (?:reached|exceeded)\b|\byour session has (?:expired|ended|timed out)\b",
        r"^(?:oops\W+|error\W+)?could not connect to the (?:database|server)\b|\byou (?:may|do) not (?:open|have (?:permission|access)|access)\b|^access (?:is |was )?denied\b",
        r"\bplease (?:try again|come back) (?:later|in <\*> (?:seconds|minutes|hours))\b|^go back to the start page\b",
        r"^content-length: <\*>$",
        r"^(?:php )?(?:warning|notice|deprecated|fatal error|parse error|uncaught exception)\s*:.{0,160}(?:\bon line <\*>|\buncaught\b|\bin /\S+)",
        r"\bthis (?:repository|page|snippet|document|project|file|content) is (?:private|restricted|no longer available|not available)\b|\bask the owner\b.{0,40}\bfor access\b",
        r"\bintrouvable\b|\bnicht gefunden\b|не найдена|no se encontró|找不到该页面|ページが見つかりません",
    ],
    "filler": [
        r"^(?:tbd|tba|todo|tk|n/a yet|xxx+|\?\?\?)\W*$",
        r"^lorem ipsum(?: dolor(?: sit(?: amet)?)?)?\W*$",
        r"\byour (?:text|content|title|description) (?:goes )?here\b|\b(?:text|content|description) goes here\b",
        r"\bplaceholder (?:paragraph|text|content)\b|\bto be (?:written|filled in|completed|announced)\b|\bcontent (?:is )?coming soon\b|^coming soon\W*$",
        r"\b(?:sample|dummy|example) text\b.{0,40}\breplace\b|\breplace (?:it|this|this text|this paragraph) with your own\b|^this is (?:sample|dummy|placeholder) text",
        r"^(?:describe|add|write|insert|put) (?:the|a|an|your|some) .{0,40}\b(?:in (?:two or three|two|three|a few|one or two) sentences|in this spot|here)\W*$",
        r"hier steht bald ihr text|ersetzen sie diesen absatz|platzhaltertext|votre texte ici|remplacez ce paragraphe|escriba aquí su texto|sustituya este párrafo|此处填写正文|请在此(?:处)?(?:输入|填写)|ここに本文を入力|ここにテキスト|здесь будет (?:ваш )?текст|(?:введите|вставьте) (?:сюда |здесь )?(?:ваш )?текст|замените этот абзац",
    ],
}
_RULES = {kind: re.compile("|".join(f"(?:{r})" for r in rules), _I) for kind, rules in _MESSAGES.items()}

#: Without one of its stems no rule of a kind can match; looking for them is cheap.
_STEMS = {
    "notice": ("script", "js is ", "cookie", "your browser", "you are", "browser check", "just a moment", "attention required", "captcha", "security check", "you're", "you’re", "ddos", "browser", "connection", "скрипт", "куки", "脚本", "スクリプト", "クッキー"),
    "error": (
        "not found", "server error", "unavailable", "gateway", "forbidden", "gone", "too many requests", "unauthorized", "bad request",
        "not allowed", "time-out", "timeout", "not implemented", "moved permanently", "<title>", "<h<", "error", "erreur", "fehler",
        "ошибка", "错误", "エラー", "錯誤", "오류", "you asked for", "you requested", "you are looking for", " was deleted", " was removed",
        " requested", "does not exist", "could not be found", "something ", "upstream", "maintenance", "rate limit", "your session",
        "could not connect", "you may not", "you do not", "denied", "please try again", "please come back", "start page",
        "content-length", "warning", "notice", "deprecated", "exception", "is private", "is restricted", "available", "for access", "introuvable", "nicht gefunden", "не найдена", "no se encontr", "找不到", "見つかりません",
        "whoops", "oops", "uh-oh", "uh oh", "uhoh", "sorry", "be reached", "be found", "be displayed", "suspended", "is disabled", "been disabled", "exceeded", "for sale", '"message"', '"status"', '"detail"',
        "non trovata", "no encontrada", "não encontrada", "niet gevonden", "hittades inte", "nie znaleziono", "찾을 수 없", "不存在", "無法找到",
    ),
    "filler": (
        "lorem ipsum", "tbd", "tba", "todo", "tk", "n/a yet", "xxx", "???", " here", "placeholder", "to be ", "coming soon", "text", "sentences", "spot", "with your own", "platzhalter",
        "absatz", "paragraphe", "párrafo", "填写", "输入", "入力", "テキスト", "текст", "абзац",
    ),
}
_SLOT_STEMS = ("{{", "${", "#{", "%(", "%%", "@@", "xx_", "<%", "{%", "&lt;", "[[", " here>", "<your", "<insert", "<enter", "<add", "[your", "[insert", "[enter", "[add", " name]", "[name]", "name%", "[date]", "[company]")

#: Forms of a slot that a template leaves for a value.
_SLOT = re.compile(
    r"\{\{\{?\s*[\w.\-| ]+\s*\}?\}\}"
    r"|[$#]\{\s*[\w.\-]+\s*\}"
    r"|%\(\w+\)[sdrf]"
    r"|%%\w+%%|@@\w+@@|\bXX_\w+_XX\b"
    r"|<%=?[ \w.]+%>|\{%[ \w.\-]+%\}"
    r"|<(?:YOUR|INSERT|ENTER|ADD)[-_ ][A-Z0-9_\- ]+>|<(?:your|insert|enter)[-_ ][\w\- ]+>|<[\w\- ]+ (?:goes )?here>"
    r"|\[(?:your|insert|enter|add|YOUR|INSERT|ENTER|ADD|Your|Insert|Enter)[-_ ][^\]\n]{1,60}\](?!\()"
    r"|\[(?:(?:First|Last|Full|Company|Customer|User|Product|Project|Recipient|Client) Name|Name|Company|Date)\](?!\()|%(?:FIRST|LAST|FULL|USER|COMPANY|CUSTOMER|RECIPIENT)_?NAME%"
    r"|\[\[\s*[A-Z][A-Z0-9_]*\s*\]\]|&lt;\s*[\w\- ]+\s*&gt;"
)
#: Code and quotations inside a line: what stands there is shown, not left over.
_SHOWN = re.compile(r"`[^`]*`|\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)|“[^”]*”|«[^»]*»|„[^“]*“")
_CODE_LINE = re.compile(
    r"^\s*(?:return|import|from|export|const|let|var|def|func|class|public|private|if\s*\(|for\s*\(|while\s*\(|else|elif|echo|test|printf?|set|cd|rm|cp|mv|curl|sudo|docker|run:|select|insert into|update)\b"
    r"|^\s*<[a-z!/]|</|=>|:=|&&|\|\||[;{(]\s*$|^\s*[\w.]+\s*[=+]=?\s*\S|^\s*[\w\-\"']+:\s*[\"'{\[]",
    _I,
)


def mask(message: str) -> str:
    """The message with its numbers replaced by ``<*>`` and single blanks."""
    return " ".join(_DIGITS.sub("<*>", message).split())


def parts_of(template: str) -> tuple[tuple[str, str, float], ...]:
    """``kind, part, share`` of the parts of a template that are flagged; the share is that
    of its length. One that is short, or begins with what gives it away, is flagged as a
    whole; of others the sentences that do, else the phrase that does."""
    words = template.split()
    kind = classify(" ".join(words[:HEAD]) + (" <*>" if len(words) > HEAD else ""))
    if kind:
        return ((kind, template, 1.0),)
    if len(words) <= HEAD or not may_match(template):
        return ()
    sentences = [(classify(s), s) for s in map(str.strip, _SENTENCES.split(template)) if s]
    return tuple((k, s, len(s) / len(template)) for k, s in sentences if k) or _phrase(template)


def classify(template: str) -> str | None:
    """The kind of a template: ``notice``, ``error``, ``filler`` or None."""
    low = template.lower()
    for kind, rule in _RULES.items():
        if any(stem in low for stem in _STEMS[kind]) and rule.search(template):
            return kind
    return None


_ANY_STEM = sorted({x for stems in _STEMS.values() for x in stems}, key=len)
_ANY_STEM = [x for at, x in enumerate(_ANY_STEM) if not any(y in x for y in _ANY_STEM[:at])]


def stems_in(text: str) -> list[str]:
    """The stems in a text; those of each of its messages are among them."""
    low = mask(text).lower()
    return [x for x in _ANY_STEM if x in low]


def may_match(message: str) -> bool:
    """Whether any rule can match the message or a template it merges into."""
    low = message.lower()
    return any(x in low for x in _ANY_STEM)


def _phrase(message: str) -> tuple[tuple[str, str, float], ...]:
    """What a rule finds across the sentences of a message."""
    for kind, rule in _RULES.items():
        found = rule.search(message)
        if found:
            return ((kind, found.group(), len(found.group()) / len(message)),)
    return ()


def _is_filling(line: str) -> bool:
    if len(line) < 2 * LATIN_WORDS - 1:
        return False
    words = _WORDS.findall(line.lower())
    if len(words) < LATIN_WORDS:
        return False
    return max(sum(w in _LATIN for w in words), sum(w in _MASH for w in words)) >= LATIN_SHARE * len(words)


class Leaf:
    """A leaf of the prefix tree: messages of one length that begin alike. A message joins
    the first template of which, with it, at least ``KEPT_SHARE`` of the words stay the
    same, and the places where they differ become ``<*>``."""

    def __init__(self, words: int):
        self.words = words
        self.least = -(-words * KEPT_SHARE // 1)
        # two that differ in no more words than these blocks, less one, agree in a whole block
        blocks = int(words - self.least) + 1
        rest = max(words - DEPTH, 0)
        self.blocks = [slice(DEPTH + rest * b // blocks, DEPTH + rest * (b + 1) // blocks) for b in range(blocks)]
        self.templates: list[list[str]] = []
        self.support: list[int] = []
        self._by_block: dict[tuple, list[int]] = {}

    def add(self, words: list[str], support: int) -> int:
        """The number of the template the message joins."""
        near = sorted({t for key in self._keys(words) for t in self._by_block.get(key, ())})
        for t in near:
            own = self.templates[t]
            same = [a == b for a, b in zip(own, words)]
            if sum(s and a != "<*>" or a == b == "<*>" for s, a, b in zip(same, own, words)) >= self.least:
                before = self._keys(own)
                self.templates[t] = own = [a if s else "<*>" for s, a in zip(same, own)]
                for key in set(self._keys(own)).difference(before):
                    self._by_block.setdefault(key, []).append(t)
                self.support[t] += support
                return t
        t = len(self.templates)
        self.templates.append(list(words))
        self.support.append(support)
        for key in self._keys(words):
            self._by_block.setdefault(key, []).append(t)
        return t

    def _keys(self, words: list[str]) -> list[tuple]:
        return [(b, *words[block]) for b, block in enumerate(self.blocks)]

    def verdicts(self, members: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, str, float, int]]:
        """``place in members, its template's text, kind, share, support`` of the flagged
        ones. A template is judged once; one whose own words don't tell, as what tells is
        where its messages differ, takes the verdict that most of them have. Where most
        have none, the messages that do tell are templates of their own."""
        mine: dict[int, list[int]] = {}
        for at, (t, _, _) in enumerate(members):
            mine.setdefault(t, []).append(at)
        for t, places in mine.items():
            text = " ".join(self.templates[t])
            found = parts_of(text)
            if not found and len(places) > 1:
                told = {at: own for at in places if (own := parts_of(members[at][1]))}
                votes: dict[tuple, int] = {}
                for at, own in told.items():
                    votes[own] = votes.get(own, 0) + members[at][2]
                if 2 * sum(votes.values()) >= self.support[t]:
                    found = max(votes, key=lambda own: (votes[own], own))
                else:
                    for at, own in told.items():
                        yield from ((at, members[at][1], *verdict, members[at][2]) for verdict in _by_kind(own))
            for verdict in _by_kind(found):
                yield from ((at, text, *verdict, self.support[t]) for at in places)


def _by_kind(found: tuple[tuple[str, str, float], ...]) -> list[tuple[str, float]]:
    return [(kind, sum(x for k, _, x in found if k == kind)) for kind in sorted({k for k, _, _ in found})]


_EVIDENCE = "row bigint, reason string, total bigint, messages array<struct<h:bigint, leaf:bigint, text:string, size:bigint>>"


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Every line with something in it, and whether it is fenced code."""
    fenced = False
    for line in _LINES.split(text):
        if _FENCE.match(line):
            fenced = not fenced
        elif line := line.strip():
            yield line, fenced


def record_evidence(text: str | None) -> tuple[str | None, int, list[tuple[str, int]]] | None:
    """What a text holds: a reason to leave it out that stands by itself (``slot``,
    ``filler``; None if there is none), the length of all its lines, and each line that is
    not fenced code, masked, with its length. All lines are read, whatever stands in
    others. None: there is no text."""
    if not text:
        return None
    low = text.lower()
    slots = any(stem in low for stem in _SLOT_STEMS)
    reason, total = None, 0
    messages: list[tuple[str, int]] = []
    for line, fenced in _lines(text):
        total += len(line)
        if fenced:
            continue
        messages.append((mask(line), len(line)))
        if reason is None and slots and _SLOT.search(line):
            plain = _SHOWN.sub(" ", line)
            if _SLOT.search(plain) and not _CODE_LINE.search(_SLOT.sub(" ", plain)):
                reason = "slot"
        if reason is None and _is_filling(line):
            reason = "filler"
    return reason, total, messages


def _decide(total: int, taken: dict[str, int]) -> str | None:
    """Whether flagged messages take the place of content: beside them stands no more
    than ``SIDE_TEXT`` characters, or no more than they hold themselves."""
    own = sum(taken.values())
    if own and total - own <= max(SIDE_TEXT, own):
        return max(taken, key=lambda k: (taken[k], k))
    return None


def find_residue(text: str | None) -> str | None:
    """Why one text is to be left out, judged by its own messages alone: ``slot``,
    ``notice``, ``error``, ``filler``; or None."""
    found = record_evidence(text)
    if found is None or found[0]:
        return found and found[0]
    _, total, messages = found
    taken: dict[str, int] = {}
    for masked, size in messages:
        for kind, _, share in parts_of(masked):
            taken[kind] = taken.get(kind, 0) + round(share * size)
    return _decide(total, taken)


def _digest(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def leaf_of(message: str) -> int:
    """A hash of the leaf of the prefix tree that a message is routed to."""
    words = message.split(" ")
    return _digest(" ".join([str(len(words)), *words[:DEPTH]]))


def stem_leaves(documents: DataFrame, text: str) -> DataFrame:
    """``leaf``: the leaves with a message that a rule can match, over all lines of all
    texts, written once. Templates of other leaves can't be flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = set()
            for t in batch.column(0).to_pylist():
                stems = stems_in(t) if t else []
                if stems:
                    for line, fenced in _lines(t):
                        if not fenced:
                            message = mask(line)
                            low = message.lower()
                            if any(x in low for x in stems):
                                leaves.add(leaf_of(message))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(leaves), pa.int64())], names=["leaf"])

    return cut(documents.select(F.col(text).alias("_t")).mapInArrow(run, "leaf bigint").distinct())


def leaf_filter(leaves: DataFrame) -> np.ndarray:
    """A Bloom filter of the leaves, as 64-bit words; its size goes by their number."""
    bits = min(1 << math.ceil(math.log2(max(1 << 16, BITS_PER_LEAF * leaves.count()))), MAX_FILTER_BITS)
    place = F.explode(F.array(F.col("leaf").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("leaf", 32).bitwiseAND(F.lit(bits - 1))))
    words = leaves.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def in_filter(table: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Which of the leaves the filter may hold."""
    h, last = leaves.view(np.uint64), np.uint64(64 * len(table) - 1)
    hit = np.ones(len(h), bool)
    for p in (h & last, (h >> np.uint64(32)) & last):
        hit &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def collect_evidence(documents: DataFrame, key: str | None, text: str) -> DataFrame:
    """``<key>, row, reason, total, messages`` of the rows with a reason, or with lines of a
    leaf that holds a message a rule can match, written once; ``row`` tells rows apart,
    ``total`` is the length of all its lines. Such lines are all kept, with or without a
    stem of a rule themselves, and whatever else stands in their record."""
    shared = documents.sparkSession.sparkContext.broadcast(leaf_filter(stem_leaves(documents, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(first, TEXTS_AT_ONCE)
                found = [record_evidence(t) or (None, 0, []) for t in part.column(2).to_pylist()]
                leaves = [leaf_of(m) for _, _, messages in found for m, _ in messages]
                hits, at = in_filter(shared.value, np.array(leaves, np.int64)).tolist(), 0
                for k, (n, (reason, total, messages)) in enumerate(zip(part.column(1).to_pylist(), found), first):
                    kept = [{"h": _digest(m), "leaf": leaves[j], "text": m, "size": x} for j, (m, x) in enumerate(messages, at) if hits[j]]
                    at += len(messages)
                    if reason or kept:
                        rows.append(k)
                        out.append({"row": n, "reason": reason, "total": total, "messages": kept})
            types = pa.list_(pa.struct([("h", pa.int64()), ("leaf", pa.int64()), ("text", pa.string()), ("size", pa.int64())]))
            cols = [pa.array([r[c] for r in out], t) for c, t in (("row", pa.int64()), ("reason", pa.string()), ("total", pa.int64()), ("messages", types))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=[key or "_k", "row", "reason", "total", "messages"])

    kind = documents.schema[key].dataType.simpleString() if key else "int"
    rows = documents.select(F.col(key) if key else F.lit(0).alias("_k"), F.monotonically_increasing_id().alias("_n"), F.col(text).alias("_t"))
    return cut(rows.mapInArrow(run, f"`{key or '_k'}` {kind}, {_EVIDENCE}"))


def mined_templates(evidence: DataFrame) -> DataFrame:
    """``h, template, kind, share, messages, support``: the flagged messages, each with the
    template it belongs to, how often it occurs itself and how often the template does.

    Equal messages are counted with a map-side combine. Those of one leaf of the prefix
    tree (equal number of words, equal first ``DEPTH`` words) meet in one task, sorted, so
    that merging depends on the collection alone; a task holds one leaf at a time.
    """
    each = evidence.select(F.explode("messages").alias("m")).select("m.h", "m.leaf", "m.text")
    leaves = each.groupBy("h").agg(F.min("text").alias("text"), F.count("*").alias("n"), F.min("leaf").alias("leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []

        def mine() -> pa.RecordBatch:
            out: list[tuple] = []
            trees: dict[tuple, tuple[Leaf, list]] = {}
            for h, text, n in waiting:
                words = text.split(" ")
                leaf, members = trees.setdefault((len(words), *words[:DEPTH]), (Leaf(len(words)), []))
                members.append((leaf.add(words, n), h, text, n))
            for leaf, members in trees.values():
                for at, *verdict, support in leaf.verdicts([(t, text, n) for t, _, text, n in members]):
                    out.append((members[at][1], *verdict, members[at][3], support))
            cols = list(zip(*out)) or [()] * 6
            types = pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["h", "template", "kind", "share", "messages", "support"])

        for batch in batches:
            for h, text, n, leaf in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if leaf != now and waiting:
                    yield mine()
                    waiting = []
                now = leaf
                waiting.append((h, text, n))
        if waiting:
            yield mine()

    return leaves.repartition("leaf").sortWithinPartitions("leaf", "text").mapInArrow(run, "h bigint, template string, kind string, share double, messages bigint, support bigint")


def template_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, reason`` of the rows to leave out: ``slot`` for an unfilled placeholder
    left in prose, ``filler``, ``error`` or ``notice`` for text in place of content.

    Every line of every text but fenced code is a message. A first pass over the texts
    finds the leaves of the prefix tree that hold a message with a stem of a rule; a second
    one sets apart all messages of these leaves, with or without a stem, in records of any
    length. Other leaves can't have a flagged template. Templates are mined from the
    messages over the whole collection with the fixed-depth prefix tree, each template is
    judged once, and its verdict goes back to all its messages, also to those whose own
    words don't tell. A line is judged whole and sentence by sentence. A record falls if
    its flagged messages take the place of content (``_decide``). A paragraph of filler
    Latin or a slot in a prose line falls wherever it stands, by itself. Fenced code,
    inline code, quotations and lines of code are not looked at for slots, and fenced
    code not for messages: they show such things and don't suffer from them.

    Null and empty texts are kept (no row), rows with a null key may come out with it,
    repeated rows come out repeatedly, texts of any length are read whole, an empty table
    gives no rows, other columns are ignored. The join of messages and verdicts is
    salted, as one message may be that of a third of all records.
    """
    evidence = collect_evidence(documents, key, text)
    flagged = mined_templates(evidence).select("h", "kind", "share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = evidence.where("reason IS NULL").select("row", F.explode("messages").alias("m")).select("row", "m.h", "m.size", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    taken = held.join(flagged, ["h", "salt"]).groupBy("row", "kind").agg(F.sum(F.round(F.col("share") * F.col("size"))).cast("bigint").alias("n"))
    most = taken.groupBy("row").agg(F.sum("n").alias("own"), F.max(F.struct("n", "kind")).getField("kind").alias("found"))
    met = evidence.where("reason IS NULL").select(key, "row", "total").join(most, "row")
    rest = F.col("total") - F.col("own")
    fallen = met.where((F.col("own") > 0) & (rest <= F.greatest(F.lit(SIDE_TEXT), F.col("own"))))
    return evidence.where("reason IS NOT NULL").select(key, "reason").unionByName(fallen.select(key, F.col("found").alias("reason")))


def message_templates(documents: DataFrame, text: str = "text") -> DataFrame:
    """``template, kind, messages, members``: the flagged templates mined from a collection,
    how many lines follow them, and how many different ones."""
    found = mined_templates(collect_evidence(documents, None, text))
    return found.groupBy("template", "kind").agg(F.sum("messages").alias("messages"), F.count("*").alias("members"))
