"""Readers, wire decoders and the derived catalog used by the registered queries."""
