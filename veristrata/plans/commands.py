"""Question ids with fixed commands: an approved id runs its commands in the controlled language, free text never."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .algebra import Plan, Refused
from .language import Resolver, parse


def compile_commands(commands: Mapping[str, Sequence[str]], slots: Mapping[str, str], question_id: str, release: str, resolver: Resolver, limit: int = 50) -> tuple[Plan, ...]:
    """The plans of ``question_id``. ``commands``: templates by id, or by a prefix of ids that ends with ``*``;
    ``slots``: approved names that fill them. An id without commands, or a slot without a name, is refused."""
    own = commands.get(question_id)
    if own is None:
        prefixes = [p for p in commands if p.endswith("*") and question_id.startswith(p[:-1])]
        if not prefixes:
            raise Refused("question_without_mapping", question_id)
        own = commands[max(prefixes, key=len)]
    try:
        texts = [template.format_map(slots) for template in own]
    except KeyError as e:
        raise Refused("unbound_entity_slot", str(e)) from e
    return tuple(parse(text, release, resolver, limit) for text in texts)
