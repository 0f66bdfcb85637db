"""Prompts that models are asked with, kept as package files."""

from importlib.resources import files

PHOTO_CARD, PHOTO_CARD_VERSION = "photo_card.md", "photo-card-1"


def prompt(name: str = PHOTO_CARD) -> str:
    return files(__package__).joinpath(name).read_text(encoding="utf-8")
