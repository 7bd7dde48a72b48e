"""Prompt templates for bulk model requests.

Fixed values: the two templates below must equal the reference's text for
the requests to be the same.  Placeholders are ``{topic}``, ``{date}``,
``{message_count}`` and ``{conversation}``; they are filled by column
concatenation, never by string formatting of user text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION_PROMPT = """Analyze this conversation between a senior engineer (25+ years experience) and an AI assistant.

Topic: {topic}
Date: {date}

Extract valuable insights in these categories:
1. **Wisdom Nuggets**: Hard-won insights, mental models, counterintuitive learnings, architectural principles
2. **Product Ideas**: Business opportunities, feature ideas, market gaps, tool ideas
3. **Programming Tips**: Code patterns, debugging techniques, tool recommendations, best practices
4. **Questions Worth Revisiting**: Deep questions that deserve more exploration, unresolved problems

For each insight found, provide:
- category: one of ["wisdom", "product_idea", "programming_tip", "question"]
- title: concise title (5-10 words)
- summary: 2-3 sentence explanation of the insight
- tags: relevant keywords (3-5 tags)
- confidence: 0.0-1.0 how clearly this is a valuable, actionable insight

Focus on:
- Insights that show experienced engineering judgment
- Non-obvious solutions or approaches
- Reusable patterns or principles
- Ideas with real-world applicability

Skip generic advice or basic information. Return ONLY a valid JSON array, no other text. If no valuable insights, return [].

<conversation>
{conversation}
</conversation>"""

SUMMARY_PROMPT = """Summarize this conversation between a senior engineer and an AI assistant.

Topic: {topic}
Date: {date}
Message count: {message_count}

Provide a structured summary with:
- summary: 2-4 sentence overview of what was discussed and accomplished
- key_topics: array of 3-6 main topics/technologies discussed
- sentiment: the overall tone (one of: "technical", "exploratory", "debugging", "learning", "planning", "creative", "frustrated", "collaborative")
- outcome: what happened (one of: "resolved", "ongoing", "abandoned", "learning", "decision_made", "idea_generated")

Return ONLY a valid JSON object with these fields, no other text.

<conversation>
{conversation}
</conversation>"""

_SLOT = re.compile(r"\{(\w+)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ('text', s) and ('slot', name) pieces."""
    out, pos = [], 0
    for m in _SLOT.finditer(template):
        out.append(("text", template[pos:m.start()]))
        out.append(("slot", m.group(1)))
        pos = m.end()
    out.append(("text", template[pos:]))
    return [p for p in out if p != ("text", "")]


def fill(template: str, **slots: Column) -> Column:
    """The template as one string column, slots taken from columns."""
    pieces = []
    for kind, value in template_parts(template):
        pieces.append(F.lit(value) if kind == "text" else slots[value].cast("string"))
    return F.concat(*pieces)
