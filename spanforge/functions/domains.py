"""Closed value domains."""

# Label, type and status domains.
EMOTIONS = ("angry", "excited", "fear", "sad", "surprised", "frustrated", "happy", "disappointed")
CAPTION_EMOTIONS = (*EMOTIONS, "neutral", "unrelevant")
QUERY_TYPES = ("explicit_event", "emotion_state", "evidence_cue")
DECISIONS = ("pass", "fail", "revise")
STATUSES = ("accepted", "discarded")
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
EVIDENCE_RANK = {"weak": 1, "ambiguous": 2, "clear": 3}
CAPTION_WEIGHTS = {"faithfulness": 0.30, "hallucination": 0.35, "coverage": 0.20, "fluency": 0.15}

# Words that a caption must not leak.
LEAK_WORDS = (
    "angry", "anger", "excited", "excitement", "fear", "fearful", "afraid", "sad", "sadness", "surprised",
    "surprise", "frustrated", "frustration", "happy", "happiness", "disappointed", "disappointment", "shocked",
    "shock", "upset", "distressed", "distress", "anxious", "anxiety", "nervous", "worried", "worry", "joyful", "joy",
    "cheerful", "annoyed", "irritated", "furious", "terrified", "panicked", "alarmed", "enraged", "delighted",
    "elated", "gloomy", "sorrowful", "tense", "agitated", "emotional", "emotion",
)
# Words a refined query must keep one of, and words it must not gain.
EMOTION_WORDS = (
    "happy", "sad", "angry", "angrily", "fear", "fearful", "afraid", "surprised", "surprise", "excited",
    "frustrated", "frustration", "disappointed", "terrified", "terror", "joy",
)
FORBIDDEN_WORDS = (
    "serious", "concerned", "distressed", "thoughtful", "tense", "focused", "uncomfortable", "curious", "worried",
    "anxious", "confused", "pensive", "wary", "alarmed",
)

# Fixed values, by name: which inputs each caption model needs: (kind, video, audio, default confidence, clip seconds limit none).
MODELS = {
    "af3_vl": ("audio+video", True, True, "low"),
    "avocado": ("av", True, True, "medium"),
    "nemotron_omni": ("av", True, True, "low"),
    "qwen3_omni": ("av", True, True, "low"),
    "qwen_audio_vl": ("audio+video", True, True, "low"),
    "secap": ("audio", False, True, "low"),
    "timechat": ("av", True, True, "medium"),
}


def alternation(words) -> str:
    """Regex alternation, longest word first."""
    return "|".join(sorted(words, key=len, reverse=True))


def check_inputs(model: str, has_video: bool, has_audio: bool) -> None:
    """Raise if a model is unknown or lacks an input it needs."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(sorted(MODELS))}")
    _, video, audio, _ = MODELS[model]
    if video and not has_video or audio and not has_audio:
        raise ValueError(f"{model} needs {' and '.join(n for n, k in (('video', video), ('audio', audio)) if k)}")
