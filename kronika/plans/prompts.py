"""What the models are asked. `{...}` are filled in with str.format; braces of JSON are doubled."""

from __future__ import annotations

_EVENT = (
    '{{"date": "YYYY-MM-DD", "place": "...", "coordinates": {{"lat": 0.0, "lng": 0.0}}, "operation": "...", "division": "...", "notes": "...", '
    '"source_chunk_ids": [1], "source_pages": [1]}}'
)
_SHAPE = f'{{{{"movements": [{_EVENT}], "notes": ["..."]}}}}'
_LEFT_OUT = (
    "orders, directives and plans; meetings; appointments and handovers of command; seats of staffs; changes of name or subordination; "
    "commendations; hospitals; reports of strength and disposition"
)

ANSWER_SYSTEM = (
    "Answer the question about one book from the passages alone. Name the pages a statement rests on in square brackets, [p. 12] or "
    "[pp. 12-14], and no others. Where the passages do not hold the answer, say so. Be brief."
)
ANSWER_USER = "Book: {title}\n\nPassages:\n\n{context}\n\nQuestion: {question}\n\nAnswer with the pages in brackets."

EXTRACT_SYSTEM = (
    "Take the dated actions of one brigade out of passages of a book: its formation, movements, attacks, defence, evacuations and liberations. "
    "An action of a whole division counts where the text gives the brigade a part in it. Say nothing the text does not say. "
    "Your answer is one JSON object and nothing else."
)
EXTRACT_USER = (
    "Brigade: {name}\nBook: {title}\n\nPassages:\n\n{text}\n\nAnswer in this form:\n" + _SHAPE + "\n\nOne record for each action. "
    "A date is written YYYY-MM-DD as far as the text allows; of a span of days take the likeliest and mention the span in notes. coordinates are those of the "
    "place, or the middle of a route or area, or null. source_chunk_ids and source_pages name the passages a record rests on. "
    "Leave out " + _LEFT_OUT + "; units that are not the brigade's. notes of the object: what you left out or doubted."
)
REPAIR_SYSTEM = "Turn a text that should have been one JSON object into valid JSON. Keep its structure and content; add nothing."
REPAIR_USER = "This can't be read as JSON. Write it as valid JSON only:\n\n{text}"
VERIFY_SYSTEM = (
    "Check records of a brigade's actions that lie next to each other in time and may be one action told twice, with doubtful dates or rough coordinates. "
    "Join what is one action, mend what the records themselves show to be wrong, remove what is no action, invent nothing. Your answer is one JSON object and nothing else."
)
VERIFY_USER = (
    "Brigade: {name}\n\nRecords:\n\n{text}\n\nHold each record against the one before and the one after it; records of one day and area that tell of one fight are joined, and "
    "the joined record keeps all source_chunk_ids and source_pages. Use the better date where several records point to it, one spelling for a place, the best coordinates.\n"
    "Keep: the brigade's formation; battles, raids, attacks, defence, landings driven off, liberations.\n"
    "Remove: " + _LEFT_OUT + "; marches, transfers, reliefs, reserves and patrols of battalions or companies without a fight.\n"
    "operation is a title of two to eight words, such as 'Assault on Brač'; notes are facts in at most 500 characters, without remarks on how they were found.\n"
    "Answer in this form:\n" + _SHAPE
)
POLISH_SYSTEM = "Rewrite title and notes of checked records. No record is added or left out. Your answer is one JSON object and nothing else."
POLISH_USER = (
    "Brigade: {name}\n\nRecords with their index:\n\n{text}\n\nFor each give operation, a title of two to eight words such as 'Liberation of Šibenik', and notes, plain facts in "
    "at most 500 characters without pages, sources or remarks on how a date or place was found. Date, place, division and meaning stay; the language is English.\n"
    'Answer in this form:\n{{"events": [{{"index": 1, "operation": "...", "notes": "..."}}]}}'
)
