"""Label vocabularies and spellings of the annotated corpus."""

# Annotation labels in index order, the label of an undecided vote, and the ids models use.
LABELS = ["Happy", "Neutral", "Sad", "Anger", "Disgust", "Fear", "Surprise", "Other"]
NOT_SURE = "NotSure"
MODEL_IDS = {"Happy": 0, "Neutral": 1, "Sad": 2, "Disgust": 3, "Anger": 4, "Fear": 5, "Surprise": 6}
SPEAKERS = ["A", "B"]
