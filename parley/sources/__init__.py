from parley.sources.tables import (  # noqa: F401
    read, agent_events, chat_messages, chunks, speeches, frames, audio_vectors, transcripts,
    model_config, EV_TYPE_MAP, t_us,
)
