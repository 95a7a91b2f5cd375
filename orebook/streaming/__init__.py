"""The stateless machine-event steps on a streaming DataFrame."""
