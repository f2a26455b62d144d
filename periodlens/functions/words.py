"""Word lists and label names that have to stay as they are for results to match."""

# The three themes counted in song lyrics.
LOVE = [
    "heart", "love", "loved", "loving", "honey", "stay", "angel", "trust", "promise", "forever",
    "miracle", "darling", "beautiful", "cute",
]
LUST = [
    "body", "bodies", "kiss", "kissing", "kissed", "touch", "touching", "touched", "lip", "lips",
    "pussy", "taste", "tasted", "tasting", "fuck", "fucked", "fucking",
]
LONELY = [
    "lonely", "loneliness", "alone", "cold", "nobody", "empty", "silence", "silent", "lost",
    "numb", "isolated",
]

# Label order decides first-wins ties.
EMOTIONS = ["joy", "sadness", "anger", "love", "fear"]

# Features averaged per year, and the inputs of the recommender.
AUDIO_FEATURES = [
    "danceability", "energy", "loudness", "speechiness", "acousticness",
    "instrumentalness", "liveness", "valence", "tempo",
]
NEIGHBOUR_FEATURES = [
    "energy", "valence", "danceability", "acousticness", "instrumentalness",
    "speechiness", "loudness", "tempo", "liveness", "mode", "key_folded",
]
# Columns without gaps, and the years that are kept.
REQUIRED_COLUMNS = ["valence", "lyrics", "genre", "year", "id", "popularity", "niche_genres"]
FIRST_YEAR, LAST_YEAR = 1990, 2022
