"""Topic segments of conversations: each turn joins the open segment that is most related to it, or opens a new one."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERAL, STUB = "_general", "_stub"
#: Characters of each side's text that relatedness looks at.
LOOKED_AT = 2000
#: A turn of text is taken to have so many tokens where segments are capped by them.
TURN_TOKENS = 200

_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_SESSION = r"\[Session from ([^\]]+)\]"


def session_of(text: Column) -> Column:
    """The date of the first ``[Session from ...]`` header of a turn's text, empty without one."""
    return F.regexp_extract(text, _SESSION, 1)


@dataclass
class _Segment:
    number: int
    session: str
    primary: str
    anchor: frozenset[str]
    identity: str | None
    tags: set[str] = field(default_factory=set)
    turns: int = 0
    tokens: int = 0
    start: int | None = None
    end: int | None = None
    texts: list[str] = field(default_factory=list)

    def add(self, text: str, tags: Iterable[str], tokens: int, start: int | None, end: int | None) -> None:
        self.turns += 1
        self.tokens += tokens
        self.tags |= set(tags)
        self.start = start if self.start is None else self.start
        self.end = end
        self.texts = [*self.texts[-1:], text]


def _overlap(a: set[str] | frozenset[str], b: set[str], text_a: str, text_b: str) -> float:
    """The larger of the tags' overlap coefficient and 0.8 times the Jaccard similarity of the words."""
    tags = len(a & b) / min(len(a), len(b)) if a and b else 0.0
    if tags >= 0.8:
        return tags
    x, y = set(_WORD.findall(text_a[:LOOKED_AT].lower())), set(_WORD.findall(text_b[:LOOKED_AT].lower()))
    return max(tags, 0.8 * len(x & y) / len(x | y) if x and y else 0.0)


def _inherit_stubs(segments: list[_Segment]) -> None:
    """Stubs take the tags of the neighbour that is nearer in time, as often as one of them finds a donor."""
    for _ in segments:
        changed = False
        for k, s in enumerate(segments):
            if s.primary != STUB:
                continue
            before = segments[k - 1] if k and segments[k - 1].primary != STUB else None
            after = segments[k + 1] if k + 1 < len(segments) and segments[k + 1].primary != STUB else None
            donor = before or after
            if before and after and None not in (s.start, before.end, after.start) and abs(after.start - s.start) < abs(s.start - before.end):
                donor = after
            if donor:
                s.primary, s.tags, changed = donor.primary, set(donor.tags), True
        if not changed:
            return


def assign(turns: Iterable[tuple], most: int = 20, threshold: float = 0.5, gap: int = 1800) -> tuple[list[int], list[_Segment]]:
    """The segment of each turn (text, primary_tag, tags, session, identity, start, end), in order, and the segments.

    A turn can join a segment that has room (``most`` turns, most * 200 tokens), the same known identity, no other session
    if the turn opens one, and whose last turn ended ``gap`` seconds before it at most. A turn with general tags only
    joins the segment of the turn before it; a segment that such a turn opened takes no other topic. The primary tag of
    a segment's first turn scores 1, else tags of that first turn and the words of its last two turns are compared. The
    best score wins, of equal ones the oldest segment; below the threshold the turn opens a segment.
    """
    of, library, room, session, last = [], [], [], "", -1
    for text, primary, tags, header, identity, start, end in turns:
        session = header or session
        own, tokens = {t for t in tags if t != GENERAL}, len(text) // 4
        best, score = None, 0.0
        for s in room:
            if most and s.tokens + tokens > most * TURN_TOKENS:
                continue
            if identity is None or s.identity is None or identity != s.identity:
                continue
            if header and header != s.session:
                continue
            if gap > 0 and start is not None and s.end is not None and start - s.end > gap:
                continue
            if not own:
                found = 1.0 if s.number == last else None
            elif not s.anchor:
                found = None
            elif primary == s.primary:
                found = 1.0
            else:
                found = _overlap(s.anchor, own, " ".join(s.texts), text)
            if found is not None and found >= threshold and (best is None or found > score):
                best, score = s, found
                if score >= 1.0:
                    break
        if best is None:
            best = _Segment(len(library), session, primary, frozenset(own), identity)
            library.append(best)
            room.append(best)
        best.add(text, tags, tokens, start, end)
        if most and best.turns >= most:
            room.remove(best)
        last = best.number
        of.append(best.number)
    _inherit_stubs(library)
    return of, library


def topic_segments(turns: DataFrame, most: int = 20, threshold: float = 0.5, gap_minutes: int = 30) -> DataFrame:
    """turns (conversation_id, turn_no, text, primary_tag, tags, session, identity, started, ended) -> (conversation_id,
    turn_no, segment, primary_tag, tags): the topic segment of each turn, from 0, with the segment's tags.

    started and ended are seconds or null (then no gap splits), session is the turn's own header or empty (without the column
    it is looked for in the text), a null identity is unresolved and its turn stands alone. Turns without a text but for white space are left out, null tags are none. See
    assign() for the rules. A conversation's turns are folded in their order by one task; conversations are dealt by id.
    """
    kind = dict(turns.dtypes)["conversation_id"]
    if "session" not in turns.columns:
        turns = turns.withColumn("session", session_of(F.col("text")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_no", ignore_index=True)
        plain = [[None if pd.isna(v) else int(v) for v in pdf[c]] for c in ("started", "ended")]
        tags = [[] if t is None else list(t) for t in pdf["tags"]]
        of, library = assign(zip(pdf["text"], pdf["primary_tag"], tags, pdf["session"].fillna(""), pdf["identity"].where(pdf["identity"].notna(), None), *plain, strict=True), most, threshold, gap_minutes * 60)
        return pd.DataFrame({"conversation_id": pdf["conversation_id"], "turn_no": pdf["turn_no"], "segment": of, "primary_tag": [library[k].primary for k in of], "tags": [sorted(library[k].tags) for k in of]})

    said = turns.where(F.trim(F.col("text"), F.lit(" \t\n\r\f\v")) != "").select("conversation_id", "turn_no", "text", F.coalesce("primary_tag", F.lit(GENERAL)).alias("primary_tag"), "tags", "session", "identity", F.col("started").cast("long").alias("started"), F.col("ended").cast("long").alias("ended"))
    return said.groupBy("conversation_id").applyInPandas(fold, f"conversation_id {kind}, turn_no long, segment int, primary_tag string, tags array<string>")
