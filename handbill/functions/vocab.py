"""Fixed values of the listings model: vocabularies, patterns, tables and limits.

Fixed values: results must equal those of other producers and consumers of the
same data, so these lists and patterns are as they are, in their given order.
"""

TIME_ZONE = "America/Los_Angeles"
EVENT_TYPES = ["opening", "closing", "exhibition", "workshop", "lecture", "performance", "screening", "tour", "fair", "other"]
SPECIFIC_TYPES = ["tour", "workshop", "lecture", "performance", "screening", "opening", "closing", "fair"]
EVENTFUL_TYPES = [t for t in EVENT_TYPES if t != "exhibition"]
VENUE_TYPES = ["museum", "community", "alternative", "academic"]
#: Chips of the type filter and the types that each stands for.
TYPE_CHIPS = {
    "openingclosing": ["opening", "closing"], "workshop": ["workshop"], "lecture": ["lecture"], "performance": ["performance"],
    "screening": ["screening"], "tour": ["tour"], "other": ["other", "fair"],
}
#: The first pattern that matches names the type.
TYPE_PATTERNS = [
    ("opening", r"\b(opening|preview|vernissage|reception)\b"),
    ("closing", r"\b(closing|finissage|last\s+day|final\s+day)\b"),
    ("screening", r"\b(screenings?|films?|movies?|cinema|documentary|shorts?\s+program)\b"),
    ("performance", r"\b(performances?|concerts?|recitals?|dance|dj|live\s+music|music|theater|theatre|cabaret)\b"),
    ("workshop", r"\b(workshops?|classes?|class|hands[- ]on|drop[- ]in|art[- ]?making|makers?|camps?|craft|printmaking|studio\s+session)\b"),
    ("lecture", r"\b(lectures?|talks?|conversations?|in\s+conversation|panel|symposium|seminar|reading|poetry|book\s+(?:talk|launch|signing|club)|artist\s+talk|q\s?&\s?a)\b"),
    ("tour", r"\b(tours?|guided\s+walks?|walk[- ]?through|docent)\b"),
    ("fair", r"\b(fair|art\s?week|biennial|festival|celebration|block\s+party|family\s+day|open\s+house|open\s+studios?|gala|market|fest)\b"),
    ("exhibition", r"\b(exhibitions?|on\s+view|installations?)\b"),
]
FAMILY_WORDS = r"\b(family|families|kids?|children|childrens|all[- ]ages|toddlers?|preschool|little\s+ones|story\s?time|story\s+hour|sensory[- ]friendly)\b"
TEEN_WORDS = r"\b(teens?|teenagers?|youth|high[- ]school|young\s+adults?)\b"
FREE_PHRASE = r"\b(free\s+admission|free\s+event|free\s+to\s+attend|free\s+and\s+open|no\s+charge|admission\s+is\s+free|free\s+with\s+rsvp|rsvp[^.]{0,24}\bfree\b)\b"
FREE_WORD = r"\bfree\b"
PAID_HINT = r"\bfree\s+(?:members?|for\s+members?|parking|wifi)\b"
PRICE = r"\$\s?(\d{1,4}(?:\.\d{2})?)"
FREE_COSTS = ["0", "free", "$0", "0.00", "$0.00"]
RECURRING_WORDS = (
    r"\b(daily|weekly|every\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|day)|"
    r"(?:mondays|tuesdays|wednesdays|thursdays|fridays|saturdays|sundays)|in\s+focus\s+tour|gallery\s+tour|"
    r"exhibition\s+highlights?\s+tour|guided\s+tour|collection\s+tour|architecture[,\s]+(?:and\s+|&\s*)?garden\s+tour|"
    r"architecture\s+tour|garden\s+tour|curator'?s\s+gallery\s+tour|docent|introductory\s+film|afternoon\s+salon)\b"
)
PERMANENT_TITLE = r"\b(permanent|semi[- ]permanent)\b"
NON_EXHIBITION_TITLE = r"\b(permanent|tour|tours|supper|suppers|sips|party|happy hour|story hour|drop[- ]?in|skate|tasting|brunch|meet[- ]?up|class|workshop)\b"
TITLE_PREFIXES = [
    "opening reception for ", "opening reception: ", "opening: ", "closing reception for ", "closing reception: ",
    "artist talk: ", "lecture: ", "exhibition: ",
]
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—",
    "&ndash;": "–", "&lsquo;": "'", "&rsquo;": "'", "&ldquo;": "“", "&rdquo;": "”",
}
#: What a site's page decodes, names in any case.
DISPLAY_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}
#: Titles that some sources don't publish: called off or over, for members alone, mere admission.
CALLED_OFF = r"^\s*(PAST|CANCELED|CANCELLED|POSTPONED)[:\s]"
MEMBER_PREVIEW = r"\bmember\s+preview\b"
EVERGREEN_TITLES = ["general admission"]
JSONLD_EVENT_TYPES = [
    "event", "exhibitionevent", "exhibition", "visualartsevent", "theaterevent", "screeningevent", "educationevent",
    "socialevent", "festival", "businessevent",
]
#: Regions as boxes (region, west, south, east, north).
REGION_BOXES = [
    ("antelope", -118.95, 34.52, -117.65, 34.83), ("valley", -118.95, 34.20, -117.65, 34.52),
    ("westside", -118.95, 33.90, -118.37, 34.20), ("central", -118.37, 34.02, -118.27, 34.09),
    ("downtown", -118.27, 34.02, -118.13, 34.09), ("eastside", -118.37, 34.09, -118.13, 34.20),
    ("eastside", -118.13, 34.02, -117.65, 34.09), ("pasadena", -118.13, 34.09, -117.65, 34.20),
    ("south", -118.37, 33.90, -118.13, 34.02), ("southbay", -118.95, 33.68, -118.27, 33.90),
    ("southbay", -118.27, 33.68, -117.65, 33.90),
]
#: The map's first view: west, south, east, north.
MAP_CORE = (-118.56, 33.73, -118.10, 34.20)
EXHIBITION_HOURS = 36
PERMANENT_DAYS = 550
REPEATS = 5
ONE_OFF_DAYS = 4
GRACE_DAYS = 1
ZERO_RUNS = 3
CLOSING_BADGE_DAYS = 14
STRATEGIES = ["wp_tribe", "ical", "jsonld", "eventbrite", "feed", "custom"]
