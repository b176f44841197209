"""A script-aware subword vocabulary: normalise, segment, train, encode, decode, persist."""
