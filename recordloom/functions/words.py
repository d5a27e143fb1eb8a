"""Word lists of the span features."""

# Results depend on these very words.
NAME_SUFFIXES = (
    "Sr", "Sr.", "Jr", "Jr.", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX",
    "sr", "sr.", "jr", "jr.", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx",
)
COMMON_WORDS = (
    "'s", "I", "A", "An", "The", "But", "If", "So", "He", "She", "They", "There", "Are", "Is", "Be", "You", "Able", "About", "Across", "After", "All", "Almost", "Also", "Am", "Among",
    "And", "Any", "As", "At", "Because", "Been", "By", "Best", "Can", "Cannot", "Could", "Dear", "Did", "Do", "Does", "Either", "Else", "Ever", "Every", "For", "From", "Get", "Got",
    "Had", "Has", "Have", "Her", "Hers", "Him", "His", "How", "However", "In", "Into", "It", "Its", "Just", "Least", "Let", "Like", "Likely", "May", "Me", "Might", "Most", "Must", "My",
    "Neither", "No", "Nor", "Not", "Of", "Off", "Often", "On", "Only", "Or", "Other", "Our", "Own", "Rather", "Said", "Say", "Says", "Should", "Since", "Some", "Than", "That", "Their",
    "Then", "These", "This", "To", "Too", "Us", "Wants", "Was", "Who", "Whom", "We", "When", "Why", "What", "With", "Would", "Yet", "Your",
)
PARTICLES = ("de", "del", "van", "von", "af", "du", "d", "des", "zu", "do", "dos", "da", "das", "di", "der", "bin", "al", "la")
TITLE_PREFIXES = (
    "Dr.", "Esq.", "Hon.", "Jr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Rev.", "Sr.", "St.", "Dr", "Esq", "Hon", "Jr", "Mr", "Mrs", "Ms", "Prof", "Rev", "Sr", "St", "Sen.", "Sen", "Sens.", "Sens",
    "Lady", "Lord", "Captain", "President", "General", "Doctor", "Professor", "Senator", "Senators", "Father", "Reverend", "Earl", "Mister", "Miss", "Madam", "Chancellor", "Vice-President",
    "Dean", "Pope", "Rabbi", "Prince", "Queen", "Princess", "Leader", "Whip", "Bishop", "Chairman", "CEO", "DJ", "GM", "Democrat", "Republican", "Democratic", "Independent", "Candidate",
)
OCCUPATIONS = (
    "representative", "congressman", "congresswoman", "director", "composer", "actor", "actress", "chief", "detective", "screenwriter", "producer", "writer", "by", "investigator", "couturier",
    "musician", "artist", "photographer", "keyboardist", "bassist", "drummer", "singer", "biologist", "guitarist", "surgeon", "secretary", "curator", "archivist", "diva", "publicist",
    "painter", "designer", "reporter", "prodigy", "medalist", "pilot", "brakewoman", "manager", "goalkeeper",
)
PREFIX_VERBS = ("said", "wrote", "explained", "added", "admitted", "claimed")
FOLLOWERS = ("says", "said", "talk", "talked", "writes", "wrote", "plays", "played", "believes", "believed", "explains", "explained", "'s", "who", "starred", "whose", "the", "added", "claims", "claimed")
PLACE_BEFORE = ("the", "in", "on", "at")
PLACE_AFTER = ("avenue", "city", "street", "st", "ave", "town", "village")
PLACE_WORDS = ("theater", "theaters", "theatre", "theatres", "studio", "studios", "hotel", "bank", "cinema", "cinemas", "west", "east", "north", "south", "western", "eastern", "northern", "southern", "conference", "festival")
LIST_WORDS = (",", "and", "or", "/")
PUNCTUATION_TITLES = ("Dr.", "Esq.", "Hon.", "Jr.", "Mr.", "Mrs.", "Ms.", "Messrs.", "Mmes.", "Msgr.", "Prof.", "Rev.", "Rt. Hon.", "Sr.", "St.", "Sen.", "Sens.")
# Names of organisations, clubs and places that are never a person's, in either case. A longer list of exact spans is a parameter.
ORGANISATIONS = (
    "Capcom", "New York Times", "NFL", "NASA", "JPL", "Malin Space Science Systems", "SpaceX", "White House", "Sony", "Disney", "Walt Disney", "Touchstone", "Oscars", "Sundance", "Variety",
    "Atlantic", "Instagram", "Facebook", "Twitter",
)
CLUBS = (
    "West Bromwich Albion", "Manchester City", "Crystal Palace", "Sevilla", "Östersund", "Arsenal", "Liverpool", "Norwich City", "Red Star Belgrade", "St Johnstone", "Patriots", "Seahawks",
    "Oakland Raiders", "Dallas Cowboys", "New York Giants", "Eagles",
)
LOCATIONS = (
    "Seattle", "Philadelphia", "New Orleans", "Minnesota", "San Francisco", "Cleveland", "Arizona", "Denver", "Pyeongchang", "Seoul", "Tokyo", "Cannes", "Festival", "New York", "Washington DC",
    "America", "Britain", "Ireland", "California", "Galapagos", "Galapagos Islands",
)
