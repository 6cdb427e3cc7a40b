"""Training-data operators over text and embedding tables; nothing outside this folder imports them."""
