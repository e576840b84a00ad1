"""Writers of media bytes."""
