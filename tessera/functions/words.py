"""Word lists that results depend on."""

#: Words that don't count as content.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have "
    "how i if in into is it its me my of on or our so that the their them then there these "
    "they this to was we were what when where which who why will with would you your about "
    "should any all also just than too very more most some such only own same other s t "
    "without hey hi hello ok okay please thanks"
).split()

#: Words that stand for each other in domain questions.
SYNONYMS = {
    "deploy": ["release", "rollout", "ship"],
    "release": ["deploy", "rollout"],
    "rollback": ["revert", "undo"],
    "revert": ["rollback"],
    "db": ["database", "postgres"],
    "database": ["db", "postgres"],
    "postgres": ["database", "db"],
    "secret": ["credential", "password", "key"],
    "credential": ["secret", "password"],
    "password": ["secret", "credential"],
    "outage": ["incident", "downtime"],
    "incident": ["outage", "sev"],
    "cost": ["spend", "budget", "price"],
    "budget": ["cost", "spend"],
    "limit": ["quota", "throttle"],
    "quota": ["limit"],
    "latency": ["slow", "p99", "response"],
    "slow": ["latency"],
    "alert": ["page", "alarm"],
    "login": ["auth", "authentication", "sso"],
    "auth": ["authentication", "login", "token"],
    "migrate": ["migration", "move", "port"],
    "migration": ["migrate"],
    "backup": ["snapshot", "restore"],
    "restore": ["backup", "recovery"],
    "undo": ["rollback", "revert"],
    "keep": ["retain", "retention"],
    "kept": ["retained", "retention"],
    "max": ["maximum"],
    "maximum": ["max"],
}

#: Words of a question that only ask for memory, and name no topic.
RECALL_WORDS = (
    "remember recall leave left off where were we next step progress know about me project status what whats s did last "
    "time session hey hi hello so ok okay please again remind tell this"
).split()
