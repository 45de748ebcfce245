"""Word and phrase lists of the labelling rules.

Fixed values: results depend on them, so they are spelled out as they are.
"""

QUESTION_STARTS = [
    "are", "can", "could", "do", "does", "did", "is",
    "what", "when", "where", "who", "why", "will", "would",
]

SHORT_REPLIES = [
    "yeah", "yes", "yep", "ok", "okay", "sure", "alright", "all right", "speaking yes",
]

AGENT_PHRASES = [
    "okay okay", "okay perfect", "perfect", "cheers", "thank you", "what are your plans",
]

FAREWELLS = ["bye", "bye-bye", "goodbye"]

BACKCHANNEL_STARTS = [
    "yeah", "yes", "yep", "yup", "ok", "okay", "right", "sure",
    "alright", "uhuh", "mhm", "mm", "mhmm", "kay",
]

AGENT_KEYWORDS = [
    "thank you for calling", "how can i help", "how may i help",
    "welcome to", "what brings you in", "let me pull up",
    "i can get you", "let me show you", "what are you looking for",
    "what's your budget", "what is your budget",
    "i'd like to help", "i will help", "can i help you",
    "my name is", "this is", "i'm calling from",
    "we have", "we can offer", "let me check",
]

CUSTOMER_KEYWORDS = [
    "i'm looking for", "i am looking for", "i need",
    "i want", "my budget is", "i saw online", "i found online",
    "i called because", "interested in", "how much is", "what's the price",
    "i was told", "i'd like to buy", "i'd like to get",
]
