"""Text, XML and tree readers, and the matching sinks."""
